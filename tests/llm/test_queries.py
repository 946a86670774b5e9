"""The registered queries over the test tables, and the pipeline stage by stage."""

from __future__ import annotations

import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
from check import compare, database
from tabkit.llm import quality, secret_scan, simhash
from tabkit.llm.queries import QUERIES, SQL
from tabkit.sources import read_table
from tests.conftest import SMALL

COLUMNS = {
    1: "vec_id n_links component_id kept",
    2: "doc_id n_words n_removed kept_sha256",
    3: "doc_id held_out score predicted",
    4: "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    5: "doc_id size source_size target taken",
    6: "doc_id held_out lang_pred score",
    7: "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    8: "doc_id fingerprint component_id",
    9: "doc_id held_out n_tokens n_known train_tokens base_score score",
    10: "doc_id n_assign n_access n_hex base_sha256 spans",
    11: "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256",
    12: "item_id rank doc_id score",
    13: "doc_id n_words n_hit n_items items_sha256 contaminated",
}
TYPES = {"start": "bigint", "n_runs": "bigint", "exponent_milli": "bigint", "rank": "int", "n_hit": "bigint", "n_items": "bigint", "n_links": "bigint", "taken": "bigint", "target": "double", "predicted": "int", "ids_crc32": "bigint"}


def test_every_query_is_registered():
    assert set(QUERIES) | {"pipeline"} <= set(contract.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(SQL) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_columns_and_rows(spark, name):
    frame = QUERIES[name](spark, SMALL)
    wanted = COLUMNS[int(name[2:].split("_")[0])].split()
    assert set(wanted) <= set(frame.columns)
    kinds = dict(frame.dtypes)
    assert all(kinds[c] == t for c, t in TYPES.items() if c in kinds)
    if name.startswith("op12"):
        assert frame.groupBy("item_id").agg(F.max("rank")).where("max(rank) > 50").isEmpty()
        return
    key = "vec_id" if "vec_id" in wanted else "doc_id"
    table = read_table(spark, SMALL, "embeddings" if key == "vec_id" else "documents")
    assert {r[0] for r in frame.select(key).distinct().collect()} == {r[0] for r in table.select(key).collect()}
    if not name.startswith("op4"):
        assert frame.count() == table.count()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equal_to_sql(spark, name):
    assert compare(spark, database(SMALL), SMALL, name).startswith("equal")


@pytest.mark.parametrize("make", ["small", "edge", "none"])
def test_pipeline_by_brute_force(spark, edge_docs, no_docs, make):
    plain = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = {"small": read_table(spark, SMALL, "documents"), "edge": edge_docs, "none": no_docs}[make]
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "simhash_dedup", "secrets", "mixing", "packing"]

    rules = stages["quality_rules"](spark, docs, SMALL)
    good = []
    for r in docs.collect():
        page = quality.Page(r["text"], quality.WordHashes())
        if not page.base_failed and not any(rule.rejects(page) for rule in quality.RULES):
            good.append(tuple(r))
    assert Counter(map(tuple, rules.collect())) == Counter(good)
    assert rules.columns == docs.columns

    once = stages["simhash_dedup"](spark, rules, SMALL).collect()
    mine = sorted(rules.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    prints = [simhash.fingerprint(r["text"]) for r in mine]
    low = list(range(len(mine)))
    moved = True
    while moved:
        moved = False
        for a in range(len(mine)):
            for b in range(len(mine)):
                if low[b] < low[a] and (prints[a] ^ prints[b]).bit_count() <= 3:
                    low[a], moved = low[b], True
    assert Counter(r["doc_id"] for r in once) == Counter(mine[i]["doc_id"] for i in set(low))
    assert not Counter(map(tuple, once)) - Counter(good)

    kept = spark.createDataFrame(once, docs.schema)
    masked = stages["secrets"](spark, kept, SMALL)
    assert masked.columns == docs.columns
    texts = {r["doc_id"]: r for r in masked.collect()}
    for r in once:
        spans = secret_scan.spans_of(r["text"])
        masked_text = texts[r["doc_id"]]["text"]
        assert (masked_text == r["text"]) == (not spans)
        assert all("[secret]" in masked_text[: s + 8] for _, s, _, _ in spans)
        assert not [s for s in secret_scan.spans_of(masked_text) if r["text"][s[1] : s[2]] == masked_text[s[1] : s[2]]]

    mixed = stages["mixing"](spark, masked, SMALL)
    assert mixed.columns == docs.columns
    times = Counter(r["doc_id"] for r in mixed.collect())
    assert set(times) <= set(texts) and all(n <= 2 for n in times.values())

    pieces = stages["packing"](spark, mixed, SMALL).collect()
    assert Counter(r["doc_id"] for r in pieces if r["start"] == 0) == times
    if make == "small":
        assert corpus_pipeline.run(spark, SMALL).count() == len(pieces) > 0


def test_dedup_keeps_rows_without_an_id(spark, docs_of):
    table = docs_of([(None, "a text of its own"), (7, "another text"), (None, "another text"), (7, "a third text"), (5, None), (2, "")])
    once = dict(corpus_pipeline.STAGES)["simhash_dedup"](spark, table, SMALL)
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in once.collect()) == [
        (0, "a text of its own"), (2, ""), (7, "a third text"), (7, "another text")
    ]


HELPERS = (
    "row id bits component first rep tab run parts own other p q n node root lo hi low key copies weight c0 c1 c2 target source_size "
    "_key _source _size _print _u _own _of _rate _expected _sure _p _v _cell _fine _c1 _c2 _end _gap _words _mix_size _mix_copies "
    "_mix_copy _mix_target pos order ids pieces sequence_id offset length start doc_tokens spans items terms times doc item "
    "window n_words runs collapsed score rank group text2 a.b"
).split()


def test_stages_keep_columns_of_any_name(spark, docs_of):
    """Columns with the names that the library uses inside come out as they went in."""
    prose = [f"The old bridge number {i} stood over the quiet river while we waited for word {i * 7} of the rain to come and go again today" for i in range(12)]
    table = docs_of([(i, t, "en", "ab"[i % 2]) for i, t in enumerate(prose)])
    wide = table.select("*", *[F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")).alias(c) for c in HELPERS])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain, got = stage(spark, table, SMALL), stage(spark, wide, SMALL)
        assert got.columns == wide.columns
        rows = got.collect()
        assert Counter(tuple(r)[:5] for r in rows) == Counter(map(tuple, plain.collect())), name
        assert rows and all(r[c] == f"{c}:{r['doc_id']}" for r in rows for c in HELPERS), name
    name, packing = corpus_pipeline.STAGES[-1]
    assert Counter(map(tuple, packing(spark, wide, SMALL).collect())) == Counter(map(tuple, packing(spark, table, SMALL).collect()))


def test_held_out_rows_teach_nothing(spark, docs_of):
    """What the held-out rows hold does not change the scores of the others."""
    from tabkit.llm import suffix_tree
    from tabkit.llm.compression import held_out

    data = [(i, f"the old bridge over the river {i % 7}", "en", "a") for i in range(60)]
    other = [(d, "entirely other" if zlib.crc32(str(d).encode()) % 5 == 1 else t, *r) for d, t, *r in data]
    held = held_out("doc_id", 5, 1)
    a, b = (
        {r["doc_id"]: r["score"] for r in suffix_tree.suffix_tree_scores(docs_of(x), held).where(~F.col("held_out")).collect()}
        for x in (data, other)
    )
    assert a == b
