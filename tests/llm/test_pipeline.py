"""The pipeline's stages on a small table, each against what its stage must keep."""

import hashlib
import random

import public_tokenizers as P
import tiktoken

import corpus_pipeline
from tidewell.llm import bpe


def prose(r, n):
    return " ".join("".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(2, 9))) for _ in range(n))


def test_run(spark, tmp_path):
    r = random.Random(11)
    docs = [(i, prose(r, 60), "en", "s", 0) for i in range(30)]
    passage, item = prose(r, 55), prose(r, 40)
    docs += [(100, docs[3][1], "en", "s", 0)]  # a copy
    docs += [(101, "1234 5678", None, "s", 0), (102, None, "en", "s", 0)]  # no language
    docs += [(103, prose(r, 50) + " " + passage, "en", "s", 0), (104, prose(r, 50) + " " + passage, "en", "s", 0)]  # shared passage
    docs += [(105, prose(r, 20) + " " + item, "en", "s", 0)]  # benchmark text
    docs = [(i, t, k, s, len(t or "")) for i, t, k, s, _ in docs]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = {x.doc_id: x for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    texts = {i: t for i, t, *_ in docs}
    assert sorted(out) == [*range(30), 103, 104]
    start = texts[104].index(passage) - 1  # the space before it is shared too
    texts[104] = texts[104][:start]
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    for i, row in out.items():
        ids = library.encode_ordinary(texts[i])
        assert row.n_tokens == len(ids) and row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(texts[i].encode()).hexdigest()


def test_stages_keep_columns(spark, tmp_path):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) in (4, 5) and corpus_pipeline.ORACLE_SQL is None
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, empty, str(tmp_path))
        assert out.columns == empty.columns and out.count() == 0
