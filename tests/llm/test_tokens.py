import public_tokenizers
from tokenizers import Tokenizer

from tidemark.llm.tokens import with_token_counts
from tidemark.session import cut_lineage


def test_counts_equal_another_library(spark):
    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    other.encode_special_tokens = True
    texts = ["", "Hello  world", "Le marché était\n\nfermé…", "<|endoftext|> is text", "a" * 5000, "漢字 🙂", "word " * 30_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, None)], "id int, text string")
    got = {r["id"]: r["n_tokens"] for r in with_token_counts(df).collect()}
    assert got == {i: len(other.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)} | {99: 0}
    assert {r["n_tokens"] for r in with_token_counts(df, vocabulary=public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).where("id = 0 OR id = 99").collect()} == {0}
    assert with_token_counts(df.limit(0)).count() == 0


def test_lineage_is_cut(spark):
    df = cut_lineage(with_token_counts(spark.createDataFrame([("ab",)], "text string")))
    assert "Scan ExistingRDD" in df._jdf.queryExecution().executedPlan().toString() and df.first()["n_tokens"] == 1
