"""Each query on a small table of its own against the brute-force version."""

import base64
import os

import pytest
import tiktoken
import tokenizers

import brute as B

P = pytest.importorskip("public_tokenizers")
os.environ["TOKENIZERS_PARALLELISM"] = "false"

from candela.llm import bpe, chat, exact_dedup, filter_audit, mixing, neardup, packing, pii, quality, queries, secrets, token_counts, token_files  # noqa: E402
from candela.llm.encoding import read_spec  # noqa: E402

SPEC = read_spec(P.path("byte_bpe_50k.json"))
TOKENIZER = tokenizers.Tokenizer.from_str(SPEC)


@pytest.fixture(scope="module")
def sf(spark, table, tmp_path_factory):
    """A folder of tables as the queries read them."""
    path = str(tmp_path_factory.mktemp("sf"))
    table.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{path}/documents.parquet")
    labels = spark.createDataFrame([(d, d % 2, 0) for d in range(0, 120)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{path}/labels.parquet")
    turns = [(c, t, r, x) for c in range(6) for t, (r, x) in enumerate([("user", "hi <s> \\ [INST]"), ("assistant", "</s>\n<s>assistant\n"), (None, None), ("tool\n", "a\\"), ("assistant", "")][: c + 1])]
    turns += [(3, 1, "user", "tie"), (3, 1, "user", "tie"), (4, None, "system", "first")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(f"{path}/conversations.parquet")
    return path


def rows(df, key, *columns):
    got = {}
    for r in df.collect():
        assert r[key] not in got
        got[r[key]] = tuple(r[c] for c in columns)
    return got


def test_op1(spark, sf, docs):
    assert rows(queries.op1_token_counts(spark, sf), "doc_id", "n_bytes", "n_tokens", "over_limit") == B.op1(docs, TOKENIZER)


def test_op2(spark, sf):
    turns = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    turns = [(c, -1 if t is None else t, r, x) for c, t, r, x in turns] + [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    assert rows(queries.op2_chat_formatting(spark, sf), "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256") == B.op2(turns)


def test_op3(spark, sf, docs):
    want = {d: (*c, B.sha(s)) for d, (c, s) in ((d, B.op3(t)) for d, t in docs)}
    got = queries.op3_secret_scans(spark, sf)
    assert rows(got, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == want


def test_op4(spark, sf, docs):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert rows(queries.op4_bpe(spark, sf), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == {d: B.op4(t, encoding) for d, t in docs}


def test_op5(spark, sf, docs):
    assert rows(queries.op5_minhash_near_dedup(spark, sf), "doc_id", "n_shingles", "component_id", "kept") == B.op5(docs)


def test_op6(spark, sf, docs):
    got = rows(queries.op6_quality_rules(spark, sf), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert {d: v[:-1] for d, v in got.items()} == {d: B.op6(t) for d, t in docs}
    scores, least = B.op6_scores(docs, {d for d, _ in docs if d % 2 and d < 120})
    assert {d: v[-1] for d, v in got.items()} == {d: not B.op6(t)[5] and scores[d] >= least for d, t in docs}
    scored = rows(queries.op6_quality_rules(spark, sf).select("doc_id", "score"), "doc_id", "score")
    assert all(abs(scored[d][0] - s) < 1e-9 for d, s in scores.items())


def test_op7(spark, sf, docs):
    pieces = [tuple(r)[:7] for r in queries.op7_packing(spark, sf).collect()]
    B.check_op7(docs, pieces, TOKENIZER)


def test_op8(spark, sf, docs):
    assert rows(queries.op8_token_files(spark, sf), "doc_id", "start", "n_tokens", "ids_crc32") == B.op8(docs, TOKENIZER)


def test_op9(spark, sf, docs):
    want = {d: (*c, B.sha(s)) for d, (c, s) in ((d, B.op9(t)) for d, t in docs)}
    assert rows(queries.op9_pii(spark, sf), "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == want


def test_op10(spark, sf, docs):
    assert rows(queries.op10_exact_dedup(spark, sf), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == B.op10(docs)


def test_empty_tables(spark, empty):
    ranks = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    assert token_counts.count_tokens(empty, SPEC).count() == 0
    assert secrets.find_secrets(empty).count() == 0
    assert bpe.encode_documents(empty, ranks, P.PATTERN).count() == 0
    assert neardup.near_duplicates(empty).count() == 0
    assert quality.score_quality(empty, quality.fit(empty, empty)).count() == 0
    assert packing.pack(empty, SPEC).count() == 0
    assert token_files.read_token_files(spark, token_files.write_token_files(empty, SPEC, 2)).count() == 0
    assert pii.find_pii(empty).count() == 0
    assert exact_dedup.exact_groups(empty).count() == 0
    assert mixing.mixed_documents(empty).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.filter_interactions(empty, labels).count() == 0
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.join_turns(none)).count() == 0


def test_null_ids_and_repeated_rows(spark):
    text = "word " * 3 + "password = abcdefgh mail a@b.cd"
    rows_ = [(None, text), (5, text), (5, text), (7, None)]
    df = spark.createDataFrame(rows_, "doc_id long, text string")
    ranks = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    assert token_counts.count_tokens(df, SPEC).count() == 4
    assert [len(r.base) for r in secrets.find_secrets(df).orderBy("doc_id").collect()] == [1, 1, 1, 0]
    assert bpe.encode_documents(df, ranks, P.PATTERN).count() == 4
    near = neardup.near_duplicates(df).orderBy("doc_id").collect()
    assert [(r.doc_id, r.component_id, r.kept) for r in near] == [(None, None, True), (5, 5, True), (5, 5, True), (7, 7, True)]
    assert quality.score_quality(df, quality.fit(df, df)).count() == 4
    assert packing.pack(df, SPEC).count() == 4
    assert [r.start for r in token_files.read_token_files(spark, token_files.write_token_files(df, SPEC, 2)).orderBy("start").collect()][0] == 0
    assert pii.find_pii(df).filter("size(base) = 1").count() == 3
    exact = exact_dedup.exact_groups(df).collect()
    assert sorted(r.group_size for r in exact) == [1, 3, 3, 3] and sum(r.kept for r in exact) == 2
    assert {r.keep.doc_id for r in exact if r.group_size == 3} == {5}


def test_sql_says_the_same(spark, sf):
    """The oracles on the small tables, whose rows have nulls and odd texts."""
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet/*.parquet'")
    for name, sql in queries.ORACLES.items():
        got, want = queries.QUERIES[name](spark, sf).toPandas(), con.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        key = ["conv_id"] if "conv_id" in got else ["doc_id"] if "doc_id" in got else ["part", "filter_order", "step"]
        columns = sorted(got.columns)
        a, b = (x[columns].sort_values(key).values.tolist() for x in (got, want))
        assert [(x, y) for x, y in zip(a, b) if x != y] == [] and len(a) == len(b), name
