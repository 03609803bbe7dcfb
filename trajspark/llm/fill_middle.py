"""Fill-in-the-middle examples: texts are cut into units, and prefix, middle and suffix put into a trained order.

A unit grammar names, for each kind of unit, the class of its body and, where it has one, of the tail behind the body. It
is translated into one regular expression of zero width that looks at the two neighbouring characters: there is a
boundary wherever the character before can't go on with the one behind. `split` by it keeps every piece, so the units of
a text put together again are the text. Java's split gives an empty text one (empty) piece, so that case is counted apart.

A document's cuts and form come from a hash of the seed and its id, so reruns and retried tasks agree. Everything is one
projection: no shuffle, nothing that grows with the number of documents.

Defined results: a null text counts as empty, has no units and stays as it is (form plain, output empty). A text that
holds one of the markers stays plain, as its parts couldn't be told apart. A null id is hashed as the seed alone. Rows that
repeat an id get the same cuts if their texts are equal. An empty table gives an empty result. Input columns with the names
of result columns are replaced, all others are kept.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import clash_free, text_of, unused

RESULT = ["n", "form", "prefix_chars", "middle_chars", "output"]
MARKERS = ("<P>", "<S>", "<M>")


@dataclass(frozen=True)
class Unit:
    """A kind of unit: one character of `body`, or a run of them, and then a run of `tail` (or one) if there is any.

    Classes are the inside of a character class, such as A-Za-z or ^\\n.
    """

    body: str
    run: bool = False
    tail: str = ""
    tail_run: bool = False


#: every kind of unit of a grammar has a body class of its own, and together these hold every character
GRAMMARS: dict[str, Sequence[Unit]] = {
    "letters": (Unit("A-Za-z", run=True), Unit("^A-Za-z")),
    "characters": (Unit(r"\s\S"),),
    "words": (Unit(r"\S", run=True, tail=r"\s", tail_run=True), Unit(r"\s", run=True)),
    "lines": (Unit(r"^\n", run=True, tail=r"\n"), Unit(r"\n")),
}


def boundary(grammar: Sequence[Unit]) -> str:
    """A zero-width expression for the places between two characters that belong to different units."""
    places = []
    for unit in grammar:
        goes_on = ([unit.body] if unit.run else []) + ([unit.tail] if unit.tail else [])
        places.append((unit.body, goes_on))
        if unit.tail:
            places.append((unit.tail, [unit.tail] if unit.tail_run else []))
    cuts = dict.fromkeys(f"(?<=[{before}])" + "".join(f"(?![{c}])" for c in goes_on) for before, goes_on in places)
    return f"(?:{'|'.join(cuts)})(?!\\z)"


def units(text: Column, grammar: str | Sequence[Unit] = "letters") -> Column:
    """The units of a text, in order; none for an empty one."""
    known = GRAMMARS[grammar] if isinstance(grammar, str) else grammar
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, boundary(known)))


def _digest_number(digest: Column, k: int) -> Column:
    """The k-th group of 8 hexadecimal digits, as an unsigned integer."""
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def fill_in_middle(
    docs: DataFrame,
    grammar: str | Sequence[Unit] = "letters",
    seed: int = 1,
    used_percent: int = 90,
    spm_percent: int = 20,
    markers: tuple[str, str, str] = MARKERS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """docs with n (units), form (plain, psm, spm), prefix_chars and middle_chars (null if plain) and output.

    psm puts prefix, suffix, middle behind their markers, spm suffix, prefix, middle. used_percent of the documents are
    cut up, spm_percent of these as spm.
    """
    prefix_mark, suffix_mark, middle_mark = markers
    text = text_of(text_col)
    own = unused(docs, "fim")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    marked = F.contains(text, F.lit(prefix_mark)) | F.contains(text, F.lit(suffix_mark)) | F.contains(text, F.lit(middle_mark))
    step = docs.withColumn(own, F.struct(digest.alias("h"), units(text, grammar).alias("units")))
    h = [_digest_number(F.col(f"{own}.h"), k) for k in range(4)]
    n = F.size(f"{own}.units").cast("long")
    one, two = F.pmod(h[0], n + 1), F.pmod(h[1], n + 1)
    plain = (n == 0) | marked | (h[2] % 100 >= used_percent)
    step = step.withColumn(
        own,
        F.struct(
            F.col(f"{own}.units"),
            n.alias("n"),
            F.least(one, two).cast("int").alias("one"),
            F.greatest(one, two).cast("int").alias("two"),
            F.when(plain, "plain").when(h[3] % 100 < spm_percent, "spm").otherwise("psm").alias("form"),
        ),
    )
    at = {c: F.col(f"{own}.{c}") for c in ("units", "n", "one", "two", "form")}
    cut = at["form"] != "plain"
    part = lambda begin, length: F.when(cut, F.array_join(F.slice(at["units"], begin + 1, length), ""))
    step = step.withColumn(
        own,
        F.struct(
            at["n"],
            at["form"],
            part(F.lit(0), at["one"]).alias("prefix"),
            part(at["one"], at["two"] - at["one"]).alias("middle"),
            part(at["two"], at["n"].cast("int") - at["two"]).alias("suffix"),
        ),
    )
    prefix, middle, suffix = (F.col(f"{own}.{c}") for c in ("prefix", "middle", "suffix"))
    form = F.col(f"{own}.form")
    front, back = F.concat(F.lit(prefix_mark), prefix), F.concat(F.lit(suffix_mark), suffix)
    last = F.concat(F.lit(middle_mark), middle)
    output = F.when(form == "psm", F.concat(front, back, last)).when(form == "spm", F.concat(back, front, last)).otherwise(text)
    kept = [c for c in clash_free(docs, *RESULT).columns]
    return step.select(
        *[F.col(f"`{c}`") for c in kept],
        F.col(f"{own}.n").alias("n"),
        form.alias("form"),
        F.length(prefix).cast("long").alias("prefix_chars"),
        F.length(middle).cast("long").alias("middle_chars"),
        output.alias("output"),
    )


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that an output was made of."""
    any_mark = "|".join(rf"\Q{m}\E" for m in markers)
    parts = F.split(output, any_mark)  # nothing before the first marker, then the three parts in the form's order
    psm = F.concat(parts[1], parts[3], parts[2])
    spm = F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def oracle_sql() -> str:
    """The query op12_fill_in_middle for DuckDB."""
    number = lambda k: f"('0x' || substr(h, {8 * k + 1}, 8))::bigint"
    return f"""
    with t as (select doc_id, coalesce(text, '') as text, sha256('1:' || coalesce(doc_id::varchar, '')) as h from documents),
    u as (select *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') as units from t),
    c as (select *, len(units) as n, {number(0)} % (len(units) + 1) as x, {number(1)} % (len(units) + 1) as y from u),
    f as (select *, case when n = 0 or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>')
            or {number(2)} % 100 >= 90 then 'plain' when {number(3)} % 100 < 20 then 'spm' else 'psm' end as form from c),
    p as (select *, array_to_string(units[1:least(x, y)], '') as prefix,
            array_to_string(units[least(x, y) + 1:greatest(x, y)], '') as middle,
            array_to_string(units[greatest(x, y) + 1:n], '') as suffix from f)
    select doc_id, n::bigint as n, form,
      case when form <> 'plain' then length(prefix) end::bigint as prefix_chars,
      case when form <> 'plain' then length(middle) end::bigint as middle_chars,
      sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
        else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
      sha256(text) as restored_sha256
    from p"""
