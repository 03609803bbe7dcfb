"""The registered queries on the small tables, and each stage of the pipeline against brute force on its own input."""

from __future__ import annotations

import collections
import re
from pathlib import Path

import duckdb
import pytest
from compare import same_rows
from test_ops_small import brute_capacity, brute_components, brute_spans

import __spark_entry__ as entry
import corpus_pipeline
from trajspark.llm import toxicity
from trajspark.llm.common import materialize, table

SF_DIR = "/root/testdata/sf0.001"
INSULTS = {"loser", "idiot", "pathetic", "scum", "worthless", "moron", "clown", "trash", "disgusting", "stupid"}


def token_list(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def stages(spark):
    """(name, input rows, output rows) of each stage."""
    docs, out = table(spark, SF_DIR, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        result = materialize(stage(spark, docs, SF_DIR), name)
        out.append((name, docs.collect(), result.collect(), docs.columns, result.columns))
        docs = result
    return out


def test_registered():
    names = set(entry.queries())
    assert {f"op{n}_" for n in range(1, 11)} <= {re.match(r"op\d+_|", n)[0] for n in names} and "pipeline" in names


def test_stage_columns(stages):
    assert [s[0] for s in stages] == [n for n, _ in corpus_pipeline.STAGES]
    for _, _, _, given, made in stages[:-1]:
        assert made == given


def test_toxicity_stage(spark, stages):
    _, given, made, _, _ = stages[0]
    kept = {r.doc_id for r in made}
    scored = toxicity.toxicity(table(spark, SF_DIR, "documents"), table(spark, SF_DIR, "labels"), toxicity.label_categories())
    assert kept == {r.doc_id for r in scored.collect() if r.p_toxic < toxicity.THRESHOLD}
    toxic = {r.doc_id for r in given if len(INSULTS & set(re.findall(r"[a-z]+", r.text.lower()))) >= 2}
    clean = {r.doc_id for r in given} - toxic
    assert len(clean & kept) >= 0.9 * len(clean)


def test_toxicity_on_held_out_labels(spark):
    """At sf0.1, where labels of the classes can be held out: documents with insults against documents without."""
    sf = "/root/testdata/sf0.1"
    labels = table(spark, sf, "labels")
    scored = toxicity.toxicity(table(spark, sf, "documents"), labels.where("doc_id % 2 = 0"), toxicity.label_categories())
    held = {r.doc_id for r in labels.where("doc_id % 2 = 1").collect()}
    counts = collections.Counter()
    for r in scored.collect():
        if r.doc_id in held:
            hits = sum(w in INSULTS for w in re.findall(r"[a-z]+", r.text.lower()))
            if hits != 1:
                counts[hits > 1, r.p_toxic >= toxicity.THRESHOLD] += 1
    assert counts[True, True] >= 0.85 * (counts[True, True] + counts[True, False])
    assert counts[False, True] <= 0.06 * (counts[False, True] + counts[False, False])


def test_join_stage(stages):
    _, given, made, _, _ = stages[1]
    groups = brute_components([(r.doc_id, r.text, None) for r in given], 5, 80)
    assert sorted(r.doc_id for r in made) == sorted(i for i, (_, c) in groups.items() if i == c)


def test_decontamination_stage(spark, stages):
    _, given, made, _, _ = stages[2]
    items = [re.findall(r"[^\W_]+", r.text.lower()) for r in table(spark, SF_DIR, "benchmark").collect()]
    leaks = {
        r.doc_id for r in given
        if any(f" {' '.join(i)} " in f" {' '.join(re.findall(r'[^\W_]+', r.text.lower()))} " for i in items)
    }
    kept = {r.doc_id for r in made}
    assert not leaks & kept and leaks
    grams = [{tuple(i[k : k + 4]) for k in range(len(i) - 3)} for i in items]
    for r in given:
        if r.doc_id not in kept and r.doc_id not in leaks:  # part of an item at least
            w = re.findall(r"[^\W_]+", r.text.lower())
            own = {tuple(w[k : k + 4]) for k in range(len(w) - 3)}
            assert max(len(own & g) / max(1, len(g)) for g in grams) > 0.3


def test_mixing_stage(stages):
    _, given, made, _, _ = stages[3]
    sizes, mixed = collections.Counter(), collections.Counter()
    for r in given:
        sizes[r.source] += len(token_list(r.text))
    for r in made:
        mixed[r.source] += len(token_list(r.text))
    order = sorted(sizes)
    most = max(len(token_list(r.text)) for r in given)
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    level, capped = None, set()
    while level is None or any(s not in capped and weight[s] * level > 3 * sizes[s] for s in order):
        capped |= {s for s in order if level is not None and weight[s] * level > 3 * sizes[s]}
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        level = left / sum(weight[s] for s in order if s not in capped)
    for s in order:
        assert abs(mixed[s] - min(3 * sizes[s], weight[s] * level)) <= most
    copies = collections.Counter(r.doc_id for r in made)
    assert max(copies.values()) <= 3


def test_sharding_stage(stages):
    import hashlib

    _, given, made, _, _ = stages[4]
    assert collections.Counter(r.doc_id for r in given) == collections.Counter(r.doc_id for r in made)
    groups, loads = collections.Counter(), collections.Counter()
    for r in made:
        groups[hashlib.md5(r.text.encode()).hexdigest()] += r.size
        loads[r.shard] += r.size
    assert max(loads.values()) == brute_capacity([groups[k] for k in sorted(groups)], 40)


def test_secret_query(spark):
    import hashlib

    rows = {r.doc_id: r.text for r in table(spark, SF_DIR, "documents").collect()}
    got = entry.queries()["op6_secret_scan"](spark, SF_DIR).collect()
    assert len(got) == len(rows)
    for r in got:
        spans = brute_spans(rows[r.doc_id])
        text = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for k, _, _ in spans) for x in ("assign", "access", "hex"))


def test_licence_query_matches_sql(spark):
    connection = duckdb.connect()
    for p in Path(SF_DIR).glob("*.parquet"):
        connection.execute(f"create view {p.stem} as select * from '{p}'")
    got = entry.queries()["op9_license_digests"](spark, SF_DIR).toPandas()
    same_rows(got, connection.execute(entry.oracle_sql()["op9_license_digests"]).df())


@pytest.mark.parametrize("name", ["op1_toxic_documents", "op5_decontamination", "op8_fuzzy_line_dedup"])
def test_query_schemas(spark, name):
    got = entry.queries()[name](spark, SF_DIR)
    assert "doc_id" in got.columns and len(got.collect()) > 0
