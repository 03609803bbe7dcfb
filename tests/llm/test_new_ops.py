"""Vector codes, fill-in-the-middle and odd sketches on small tables, against brute force."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_ops_small import DOCS, brute_components, docs_of, letters, mixed_docs, words

from trajspark.llm import fill_middle, odd_sketch, queries, vector_codes

# ---- fill in the middle


def brute_fim(doc_id, text) -> tuple:
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    one, two = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = ("".join(x) for x in (units[:one], units[one:two], units[two:]))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return n, "plain", None, None, sha(text), sha(text)
    spm = h[3] % 100 < 20
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if spm else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return n, "spm" if spm else "psm", len(prefix), len(middle), sha(out), sha(text)


def fim_texts() -> list[str | None]:
    return [
        None, "", "a", "7", "ab cd", "<P>", "x <S> y", "<M", "P>", "a<P", "line\nline\r\n\n", "  ", "ünïcödé straße", "😀😀a😀", "a😀b",
        "𝒜𝒷c \U0010ffff", "é́e", "tab\tand\x0bfeed", "\\Q[a]\\E $1 ^(", "word " * 20000, "$", "a1b2c3" * 50, " x\u0085y",
    ]


def test_fill_middle_like_brute_force(spark):
    rows = [(i, t, "a") for i, t in enumerate(fim_texts() * 12)] + [(None, "no id", "a"), (3, "7", "a")]
    made = fill_middle.fill_in_middle(docs_of(spark, rows))
    got = made.select(
        "doc_id", "text", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("o"),
        F.sha2(fill_middle.restored(F.col("output"), F.col("form")), 256).alias("r"),
    ).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.o, r.r) == brute_fim(r.doc_id, r.text), (r.doc_id, r.text)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


@pytest.mark.parametrize(
    ("grammar", "pattern"),
    [("letters", r"[A-Za-z]+|[^A-Za-z]"), ("characters", r"[\s\S]"), ("words", r"\S+[ \t\n\x0b\f\r]*|[ \t\n\x0b\f\r]+"), ("lines", r"[^\n]+\n?|\n")],
)
def test_units_of_each_grammar(spark, grammar, pattern):
    texts = [t for t in fim_texts() if t is not None and " " not in t and "\u0085" not in t]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = df.select("text", fill_middle.units(F.col("text"), grammar).alias("units")).collect()
    for r in got:
        assert r.units == re.findall(pattern, r.text)


def test_fill_middle_keeps_other_columns(spark):
    docs = spark.createDataFrame([(1, "some text here", 5, "kept", 1, 2)], "doc_id long, text string, n int, fim string, h int, units int")
    made = fill_middle.fill_in_middle(docs)
    assert made.columns == ["doc_id", "text", "fim", "h", "units", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert made.first().n == 5
    empty = fill_middle.fill_in_middle(docs.limit(0))
    assert empty.count() == 0


# ---- vector codes


def brute_codes(rows: list[tuple], parts: int, entries: int, rounds: int):
    """{(id, vector, label): (codes, error)} with plain Python integers, and the codebooks."""
    good = [(i, [int(np.floor(1024 * float(x))) for x in v], lab) for i, v, lab in rows
            if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(good[0][1]) // parts
    books = [[v[k * width : (k + 1) * width] for _, v, _ in good[:entries]] for k in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def near(k, p):
        d = [dist(p, e) for e in books[k]]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        new = []
        for k in range(parts):
            of: dict[int, list] = {}
            for _, v, _ in good:
                p = v[k * width : (k + 1) * width]
                of.setdefault(near(k, p)[0], []).append(p)
            new.append([[sum(c) // len(of[e]) for c in zip(*of[e], strict=True)] if e in of else old for e, old in enumerate(books[k])])
        books = new
    out = []
    for i, v, lab in good:
        found = [near(k, v[k * width : (k + 1) * width]) for k in range(parts)]
        out.append((i, [c for c, _ in found], sum(e for _, e in found), lab))
    return out, books


VECTORS = "vec_id long, embedding array<float>, label int"


def some_vectors(n: int, length: int, seed: int = 3) -> list[tuple]:
    r = np.random.default_rng(seed)
    rows = [(int(i), [float(np.float32(x)) for x in r.normal(size=length)], int(r.integers(0, 3)) or None) for i in r.permutation(n)]
    common = [0.25] * length
    rows += [(n + i, common, 1) for i in range(n // 2)]  # a third of all rows
    rows += [(5 * n, None, 1), (5 * n + 1, [None] * length, 1), (5 * n + 2, [float("nan")] * length, 2), (5 * n + 3, [float("inf")] * length, None)]
    return [*rows, rows[0], (None, rows[1][1], None), (2, [-0.001] * length, 2)]


@pytest.mark.parametrize(("n", "entries", "common"), [(60, 16, 1024), (60, 16, 4), (5, 16, 1024)])
def test_codes_like_brute_force(spark, monkeypatch, n, entries, common):
    monkeypatch.setattr(vector_codes, "COMMON", common)
    rows = some_vectors(n, 8)
    coded = vector_codes.compress(spark.createDataFrame(rows, VECTORS), 4, entries, 4, keep=["label"])
    expected, books = brute_codes(rows, 4, entries, 4)
    assert [b.tolist() for b in coded.codebooks] == books
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    got = vector_codes.with_error_by(coded.rows, "label").collect()
    assert sorted([(r.vec_id, r.codes, r.error, r.label) for r in got], key=key) == sorted(expected, key=key)
    by_label: dict = {}
    for _, _, e, lab in expected:
        by_label[lab] = by_label.get(lab, 0) + e
    assert all(r.label_error == by_label[r.label] for r in got)


def test_codes_of_odd_tables(spark):
    df = spark.createDataFrame([], VECTORS)
    coded = vector_codes.compress(df, keep=["label"])
    assert coded.rows.count() == 0 and [b.size for b in coded.codebooks] == [0] * 4
    rows = [(1, [0.5, 1.0, 2.0], 7, "x", 1), (2, [0.5, 1.0], 7, "y", 2), (3, [0.5, 1.0, -2.0], 7, None, 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, error int, position string, `row` int")
    coded = vector_codes.compress(df, 2, 1, 1, keep=["position", "row", "error"])
    assert coded.rows.columns == ["vec_id", "position", "row", "codes", "error"]
    assert {(r.vec_id, r.position, r.row, r.error) for r in coded.rows.collect()} == {(1, "x", 1, 2048**2), (3, None, 3, 2048**2)}
    empties = spark.createDataFrame([(1, []), (2, [])], "vec_id long, embedding array<double>")
    assert [r.error for r in vector_codes.compress(empties).rows.collect()] == [0, 0]
    with pytest.raises(Exception, match="in size after scaling"):
        vector_codes.compress(spark.createDataFrame([(1, [1e300])], "vec_id long, embedding array<double>"), 1).rows.collect()


def test_nearest_in_both_arithmetics():
    r = np.random.default_rng(0)
    small, large = r.integers(-900, 900, (50, 4)), r.integers(-(1 << 25), 1 << 25, (50, 4))
    for points in (small, large):
        book = points[:7]
        code, error = vector_codes.nearest(points, book)
        d = [[sum((int(x) - int(y)) ** 2 for x, y in zip(p, b, strict=True)) for b in book] for p in points]
        assert [row.index(min(row)) for row in d] == code.tolist() and [min(row) for row in d] == error.tolist()


# ---- odd sketches


def found_components(df) -> dict:
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


@pytest.mark.parametrize(("width", "percent"), [(2, 80), (5, 80), (3, 90)])
def test_near_duplicates_like_brute_force(spark, width, percent):
    rows = mixed_docs()
    r = np.random.default_rng(width)
    for g in range(30):
        base = words(int(r.integers(3, 90)), 1000 + g, 800)
        for k in range(4):
            w = [*base]
            for _ in range(int(r.integers(0, 6))):
                w[int(r.integers(0, len(w)))] = f"x{r.integers(0, 9999)}"
            rows.append((100 + 4 * g + k, " ".join(w), "a"))
    got = found_components(odd_sketch.near_duplicates(docs_of(spark, rows), width, percent))
    assert got.pop(None) == (None, None)
    assert got == brute_components(rows, width, percent)


@pytest.mark.parametrize("heavy", [odd_sketch.HEAVY, 20])
def test_variants_of_one_text_and_of_a_template(spark, heavy):
    """Chains of variants, of which the ends don't link, and documents that share two thirds of their words but don't link."""
    r = np.random.default_rng(5)
    base = letters(80, 9)
    rows, chain = [], [*base]
    for k in range(60):
        chain = [*chain]
        for _ in range(2):
            chain[int(r.integers(0, 80))] = f"c{k}{r.integers(0, 9999)}"
        rows.append((k, " ".join(chain), "a"))
    shared = letters(120, 10)
    rows += [(200 + k, " ".join([*shared, *letters(int(r.integers(25, 60)), 5000 + k)]), "b") for k in range(80)]
    got = found_components(odd_sketch.near_duplicates(docs_of(spark, rows), 2, 80, heavy=heavy))
    assert got == brute_components(rows, 2, 80)
    assert len({c for _, c in got.values()}) > 40


def test_large_keys_lose_no_link(spark):
    """With two keys of one value, documents of a large key often agree in that key alone; none of their links may be lost."""
    r = np.random.default_rng(8)
    shared, rows = letters(100, 21), []
    for g in range(30):
        base = [*shared, *letters(45, 7000 + g)]
        for k in range(2):
            text = [*base]
            for at in r.choice(len(text), 3, replace=False):
                text[int(at)] = f"x{g}{k}{at}"
            rows.append((2 * g + k, " ".join(text), "a"))
    got = found_components(odd_sketch.near_duplicates(docs_of(spark, rows), 2, 80, bands=2, rows=1, heavy=0))
    expected = brute_components(rows, 2, 80)
    assert got == expected and 5 < len({c for _, c in expected.values()}) < 60


def test_odd_sketch_estimates(spark):
    """The estimate is near the true similarity, the bound drops few pairs at the threshold, and bits follow the formula."""
    s = odd_sketch.Sampler(odd_sketch.BANDS, odd_sketch.ROWS, odd_sketch.BITS)
    r = np.random.default_rng(1)
    most = odd_sketch.bits_at(0.8, s.samples, s.bits, 5)
    for similarity in (0.95, 0.8, 0.4):
        seen = []
        for _ in range(60):
            n = 300
            common = round(2 * n * similarity / (1 + similarity))
            pool = r.integers(0, 1 << 63, 2 * n - common).astype(np.uint64)
            a, b = pool[:n], pool[n - common :]
            minima = s.minima(np.concatenate([a, b]), np.array([0, n]))
            x, y = s.sketches(minima)
            seen.append(sum(int(v).bit_count() for v in (x ^ y)))
        assert abs(np.mean(seen) - odd_sketch.bits_at(similarity, s.samples, s.bits)) < 6
        assert abs(odd_sketch.odd_similarity(np.mean(seen), s.samples, s.bits) - similarity) < 0.03
        assert (max(seen) <= most) if similarity >= 0.8 else (min(seen) > most)


@pytest.mark.parametrize("n", [1, 30, 33, 400, 5000])
def test_parity_of_sets_bounds_their_difference(n):
    """Bits in the XOR of two set sketches are never more than elements apart, also when the larger one is folded."""
    r = np.random.default_rng(n)
    pool = np.unique(r.integers(0, 1 << 63, 3 * n).astype(np.uint64))
    a, b = pool[:n], pool[n // 10 : n // 10 + int(n * 1.2) + 1]
    apart = len(np.setxor1d(a, b))
    words, sizes = odd_sketch.parities(np.concatenate([a, b]), np.array([len(a), len(b)]))
    x, y = words[: sizes[0]], words[sizes[0] :]
    assert 64 * sizes[0] >= 2 * n and sizes[0] & (sizes[0] - 1) == 0
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    bits = sum(int(v).bit_count() for v in x ^ y)
    assert bits <= apart and bits % 2 == apart % 2 and bits >= 0.6 * apart


def test_near_duplicates_odd_tables(spark):
    empty = odd_sketch.near_duplicates(spark.createDataFrame([], DOCS))
    assert empty.columns == ["doc_id", "n_shingles", "component_id"] and empty.count() == 0
    df = spark.createDataFrame(
        [(1, "a b c", 1, "k", 1), (2, "A B  c", 2, "k", 2), (3, None, 3, "k", 3)],
        "doc_id long, text string, component_id int, keys string, doc int",
    )
    got = found_components(odd_sketch.near_duplicates(df, 2))
    assert got == {1: (2, 1), 2: (2, 1), 3: (0, 3)}


def test_new_queries(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    for name in ("documents", "embeddings"):
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    for name in ("op11_vector_codes", "op12_fill_in_middle"):
        made = queries.QUERIES[name](spark, sf_dir)
        asked = con.execute(f"select {', '.join(made.columns)} from ({queries.ORACLE_SQL[name]})").fetchall()
        assert sorted(map(str, asked)) == sorted(str(tuple(r)) for r in made.collect())
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = queries.QUERIES["op13_minhash_near_dedup"](spark, sf_dir).collect()
    expected = brute_components([(d.doc_id, d.text, None) for d in docs], 2, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_spellings_side_by_side(spark):
    from trajspark.llm import licenses

    known = {"X": "license license license organization non commercial sub license v 2"}
    texts = ["Licence licence LICENCE organisation noncommercial sublicense version 2", "license, licence; license organization non-commercial sub-licence V 2", "licence licence organisation"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    assert {(r.doc_id, r.scope) for r in licenses.find_licenses(df, known).collect()} == {(k, scope) for k in (0, 1) for scope in ("text", "line")}


def test_strays_meet_several_leaders(spark):
    """Documents outside a key's largest component meet some of its documents before they meet one another."""
    from trajspark.llm import odd_sketch

    entries = spark.createDataFrame([(0, 7, d) for d in range(40)], "band int, key long, doc long")
    component = spark.createDataFrame([(d, 0) for d in range(1, 30)], "doc long, component long")
    rows = odd_sketch._strays(entries, component, range(4)).where("stray").collect()
    assert {r.doc for r in rows} == set(range(30, 40)) and all(set(r.leads) <= set(range(30)) for r in rows)
    assert {len(r.leads) for r in rows} == {4} and len(set(rows[0].leads)) > 1
