"""What tasks hold at once: files are read and written in small pieces."""

import glob

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from evidra.llm import common, decontamination


def test_a_row_group_of_the_index_holds_a_few_segments(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 100_000, 60_000).tolist()) for _ in range(24)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    index = decontamination.build_index(docs, segment_bytes=1 << 18)
    sizes = []
    for path in {f.removeprefix("file://") for f in index.inputFiles()}:
        for f in glob.glob(path):
            meta = pq.ParquetFile(f).metadata
            sizes += [meta.row_group(k).total_byte_size for k in range(meta.num_row_groups)]
    assert index.count() == len(texts) and max(sizes) < 8 << 20 < sum(sizes)


def test_vectored_reads_are_off_unless_the_user_asks(spark):
    key = "parquet.hadoop.vectored.io.enabled"
    spark.conf.unset(key)
    common.ship(spark)
    assert spark.conf.get(key) == "false"
    spark.conf.set(key, "true")
    common.ship(spark)
    assert spark.conf.get(key) == "true"
    spark.conf.unset(key)


def test_texts_are_encoded_half_a_block_at_once():
    import public_tokenizers

    enc = common.PieceEncoder(public_tokenizers.path("word_bpe_49k.json"), False)
    texts = ["some words of a text, and more. " * 4000] * 8
    runs = list(enc.encode_column(pa.array(texts), 1))
    assert max(sum(map(len, texts[i:j])) for i, j, _, _ in runs) <= common.BLOCK_BYTES // 2
    assert len({tuple(ids[off[k] : off[k + 1]].tolist()) for _, _, ids, off in runs for k in range(len(off) - 1)}) == 1
