"""Registered queries against their SQL, or against plain Python on the smallest tables."""

import hashlib
import os
import zlib
from array import array

import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from edgetables.llm.queries import QUERIES, SQL
from tests import oracle
from tests.llm.test_texts import base_spans, pii_names

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="needs the test tables")


def table(name):
    return pq.read_table(f"{SF_DIR}/{name}.parquet").to_pylist()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    equal, message = oracle.same(QUERIES[name](spark, SF_DIR), oracle.connect(SF_DIR), SQL[name])
    assert equal, message


def test_there_is_one_query_per_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES if name.startswith("op")) == list(range(1, 14))


def test_personal_data(spark):
    rows = {r["doc_id"]: r for r in QUERIES["op1_personal_data"](spark, SF_DIR).collect()}
    for doc in table("documents"):
        want, row = base_spans(doc["text"] or ""), rows.pop(doc["doc_id"])
        names = pii_names(doc["text"] or "")
        assert row["base_sha256"] == hashlib.sha256(names.encode()).hexdigest()
        assert set(filter(None, names.split(","))) <= set(row["spans"].split(","))
        assert [row[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(s[1] == k for s in want) for k in range(4)]
    assert not rows


def test_pieces_and_files(spark):
    tokenizers = pytest.importorskip("tokenizers")
    public_tokenizers = pytest.importorskip("public_tokenizers")

    def ids(name, end):
        library = tokenizers.Tokenizer.from_file(public_tokenizers.path(name))
        return {d["doc_id"]: library.encode(d["text"] or "", add_special_tokens=False).ids + [end] for d in table("documents")}

    want = ids("word_bpe_49k.json", 1)
    for r in QUERIES["op3_pack_sequences"](spark, SF_DIR).collect():
        piece = want[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(array("I", piece).tobytes()) and r["doc_tokens"] == len(want[r["doc_id"]])
    want, at = ids("byte_bpe_50k.json", 0), 0
    for r in sorted(QUERIES["op5_token_files"](spark, SF_DIR).collect(), key=lambda r: r["doc_id"]):
        assert (r["start"], r["n_tokens"]) == (at, len(want[r["doc_id"]]))
        assert r["ids_crc32"] == zlib.crc32(array("I", want[r["doc_id"]]).tobytes())
        at += r["n_tokens"]
    for r in QUERIES["op9_unigram_pieces"](spark, SF_DIR).collect():
        text = next(d["text"] for d in table("documents") if d["doc_id"] == r["doc_id"]) or ""
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_languages(spark):
    rows = {r["doc_id"]: r for r in QUERIES["op6_language_id"](spark, SF_DIR).collect()}
    judged = [(rows[d["doc_id"]]["lang_pred"], d["lang"]) for d in table("documents") if rows[d["doc_id"]]["held_out"] and d["lang"]]
    assert sum(a == b for a, b in judged) >= 0.97 * len(judged)


def test_main_text_has_no_markup(spark):
    rows = QUERIES["op8_main_text"](spark, SF_DIR).collect()
    assert len(rows) == len(table("pages"))
    assert all(r["text"] == " ".join(r["text"].split()) and len(r["text"]) == r["n_chars"] for r in rows)
    assert not any("track(" in r["text"] or "margin:0" in r["text"] for r in rows)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    given = {d["doc_id"]: d for d in table("documents")}
    known = corpus_pipeline.identify_languages(spark, docs, SF_DIR)
    assert known.columns == docs.columns
    lettered = {k for k, d in given.items() if any(map(str.isalpha, d["text"] or ""))}
    assert {r["doc_id"] for r in known.collect()} == lettered
    kept = corpus_pipeline.drop_near_duplicates(spark, known, SF_DIR)
    assert kept.columns == docs.columns
    texts = [r["text"] for r in kept.collect()]
    assert len(texts) == len(set(texts)) and len(texts) > 0.5 * len(lettered)
    clean = corpus_pipeline.redact_personal_data(spark, kept, SF_DIR)
    assert clean.columns == docs.columns and clean.count() == len(texts)
    assert not any(base_spans(r["text"]) for r in clean.collect())
    pieces = corpus_pipeline.pack_sequences(spark, clean, SF_DIR)
    assert {r["doc_id"] for r in pieces.collect()} == {r["doc_id"] for r in clean.collect()}


ODD_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, component_id string, spans int, part int"
ENGLISH, FRENCH = "the old house by the river was sold again", "la vieille maison au bord de la rivière est vendue"


def odd_documents(spark):
    rows = [(k, f"{ENGLISH} in the year {k} by its owner number {k * k}", "en", "s", 1) for k in range(40)]
    rows += [(100 + k, f"{FRENCH} en l'an {k} par son maître {k * k}", "fr", None, None) for k in range(40)]
    rows += [(200, None, "en", "s", 1), (201, "", None, None, None), (202, " 12 - 7 ", "fr", "s", 1), (None, ENGLISH + " without an id", "en", "s", 1)]
    rows += [(300, FRENCH + " x" * 3000, None, "s", 1), (301, ENGLISH + " mail ann@example.org or 10.2.3.4", "en", "s", 1)]
    rows += [(302, "the same words twice over and over again here", "en", "s", 1)] * 2 + [(303, "the same words twice over and over again here", "en", "s", 1)]
    return spark.createDataFrame([(*row, None, "x", 3, 4) for row in rows], ODD_SCHEMA)


def test_pipeline_stages_with_odd_rows(spark):
    docs = odd_documents(spark)
    known = corpus_pipeline.identify_languages(spark, docs, SF_DIR)
    assert known.columns == corpus_pipeline.DOCUMENTS
    rows = known.collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in docs.collect()} - {200, 201, 202}
    assert {r["lang"] for r in rows if r["doc_id"] == 300} == {"fr"} and sum(r["doc_id"] == 302 for r in rows) == 2
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF_DIR)
    assert kept.columns == corpus_pipeline.DOCUMENTS
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(302) == 2 and 303 not in ids and None in ids and {200, 201, 202} <= set(ids)
    clean = corpus_pipeline.redact_personal_data(spark, docs, SF_DIR)
    texts = {r["doc_id"]: r for r in clean.collect()}
    assert clean.columns == corpus_pipeline.DOCUMENTS and clean.count() == docs.count()
    assert texts[301]["text"].endswith("mail [EMAIL] or [IP]") and texts[301]["n_chars"] == len(texts[301]["text"])
    assert texts[200]["text"] in (None, "") and not texts[200]["n_chars"]
    pieces = corpus_pipeline.pack_sequences(spark, docs, SF_DIR).collect()
    assert sum(r["length"] for r in pieces if r["start"] == 0) and sum(r["doc_id"] == 302 for r in pieces) >= 2
    starts = sorted((r["sequence_id"] * 2048 + r["offset"], r["length"]) for r in pieces)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:])) and starts[0][0] == 0


def test_pipeline_of_nothing(spark):
    none = spark.createDataFrame([], ODD_SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF_DIR).count() == 0
