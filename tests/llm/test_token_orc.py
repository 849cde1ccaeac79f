"""Operator 1 against the library on whole texts, and its files."""

import struct
import zlib

import public_tokenizers
from tokenizers import Tokenizer

from factloom.llm import common, token_orc
from tests.llm.helpers import documents

PATH = public_tokenizers.path("word_bpe_49k.json")


def reference(texts):
    t = Tokenizer.from_file(PATH)
    return [e.ids + [1] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def check(spark, docs):
    path = common.scratch(spark, "t")
    token_orc.write(docs, path, PATH, 1, 3)
    got = sorted(map(tuple, token_orc.digest(spark, path).collect()), key=lambda r: r[1])
    rows = docs.select("doc_id", "text").collect()
    want = sorted(((r[0], x) for r, x in zip(rows, reference([r[1] for r in rows]), strict=True)), key=lambda x: (x[0] is not None, x[0] or 0))
    assert [g[0] for g in got] == [w[0] for w in want]
    start, seen = 0, []
    for g in got:
        assert g[1] == start
        start += g[2]
        seen.append((g[0], g[2], g[3]))
    assert sorted(map(repr, seen)) == sorted(repr((i, len(x), zlib.crc32(struct.pack(f"<{len(x)}I", *x)))) for i, x in want)
    return path


def test_odd_texts_match_the_library(spark):
    check(spark, documents(spark))


def test_special_tokens_are_those_of_the_library(spark):
    texts = ["<|endoftext|>", "a<|endoftext|>b c<|startoftext|>", "<|ENDOFTEXT|> <|end oftext|>", "<|endoftext|><|endoftext|>é", "x <|endoftext| > y", "don't<|startoftext|>'s", "<|endoftext|>\n\n<|startoftext|>  "]
    check(spark, documents(spark, texts))
    assert reference(texts)[0] == [49407, 1]


def test_table(spark):
    check(spark, spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


def test_empty(spark):
    docs = documents(spark).limit(0)
    path = common.scratch(spark, "t")
    token_orc.write(docs, path, PATH, 1)
    assert token_orc.digest(spark, path).count() == 0


def test_files_hold_indexes_and_bloom_filters(spark):
    """What the footers and the stripes' own indexes say."""
    path = check(spark, spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    files = [r.path for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.orc").load(path).select("path").collect()]
    columns = 6 + 1  # the root, the columns, and the items of ids
    for f in files:
        reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(f), jvm.org.apache.orc.OrcFile.readerOptions(conf))
        assert reader.getRowIndexStride() == 2000 and reader.getCompressionKind().toString() == "ZSTD"
        wanted = spark.sparkContext._gateway.new_array(jvm.boolean, columns)
        for i in range(columns):
            wanted[i] = True
        rows = reader.rows()
        for i in range(reader.getStripes().size()):
            index = rows.readRowIndex(i, wanted, wanted)
            groups = -(-reader.getStripes().get(i).getNumberOfRows() // 2000)
            assert index.getRowGroupIndex()[3].getEntryCount() == groups and index.getBloomFilterIndex()[3].getBloomFilterCount() == groups
            assert index.getBloomFilterIndex()[4] is None


def test_a_filter_skips_rows(spark):
    """A file of five row groups gives back one for an id it holds, and none for an id in its range that the Bloom filter lacks."""
    path = common.scratch(spark, "t")
    docs = spark.range(10_000).selectExpr("id * 2 AS doc_id", "'a b' AS text")
    token_orc.write(docs, path, PATH, 1, 1)

    def read(test):
        df = token_orc.read(spark, path).where(test).select("doc_id", "n_tokens")
        found = len(df.collect())
        return found, df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numOutputRows").value()

    assert read("doc_id >= 0")[1] == 10_000
    assert read("doc_id = 8000") == (1, 2000)
    assert read("doc_id = 8001")[0] == 0 and sum(read(f"doc_id = {i}")[1] == 0 for i in range(4001, 4101, 2)) >= 45
