"""Fuzzy line deduplication: SimHash, pigeonhole blocks, edit similarity, connected groups. DataFrame operations only.

A line is normalised to its words in lower case, without digits and ASCII punctuation. Equal normal forms collapse first.
Each form gets a 64-bit SimHash of its word pairs: bit by bit the majority of the pairs' hashes (single words would give
all long lines of one language much the same SimHash). SimHashes within DISTANCE bits agree on BLOCKS - DISTANCE blocks
of 16 bits at least, so two forms meet under a key of KEPT of their BLOCKS blocks. A word changed in a short line moves
its SimHash further than any pigeonhole reaches, so each form also has the least of its word pairs' hashes under LEAST
hash functions, and two forms that agree on two of these meet as well. Forms of SHORT characters at most also meet by what
is left of them without one word (or, of a single word, without one letter), so that a word replaced, misspelt, put in or
taken out doesn't part them. All keys have 32 bits at least, so that chance meetings stay rare beside true ones. Forms that
meet, have SimHashes within FAR bits (unrelated lines differ in 32; not asked of short forms) and similar lengths are
verified by edit similarity (1 - distance / longer length) of their normal forms.

Each key's forms are first paired with the key's smallest form, and verified links form groups. Forms of different
groups under a key (lines that have a passage in common, say) then meet under finer keys, the key with one more block,
least hash or class of length, and are paired with the smallest form of each of these. So pairs grow with the forms and
not with the square of a key's forms. Of each connected group the first occurrence (smallest id, then line number) stays.

The keys are a sieve: lines that share most of their word pairs meet, and short ones that differ in a word; others that
have the similarity, by changes all along the line say, may not (README has the recall by length and similarity). Equal normal forms are always found, and no link is false.

Defined results: lines without a letter are kept as they are. A null text has no lines and stays null. Rows without an
id are kept as they are. Rows that repeat an id are one document: lines of one text at one place are one occurrence. An
empty table gives an empty result. Very long lines count with all their words.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, discard, materialize, small, unused

DISTANCE = 2
BLOCKS = 4
KEPT = BLOCKS - DISTANCE
WIDTH = 16  # bits of a block
LEAST = 6
FAR = 22
SHORT = 80  # characters
SIMILARITY = 0.8
PAIRS = 2000  # verified by a task
PIECE = 256  # characters
PIECEWISE = 1024  # characters from which on distances are first tried piece by piece
CHUNK = 127  # pairs that a byte (the last one with its sign) can count
_LEAST = [f"m{k}" for k in range(LEAST)]


def normal_form(line: Column) -> Column:
    """Runs of ASCII letters and other characters beyond ASCII, in lower case, with single blanks."""
    between = r"[\x00-\x60\x7B-\x7F]+"  # one class: a pattern of two alternatives that leaves single blanks alone takes longer
    return F.trim(F.regexp_replace(F.lower(line), between, " "))


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, line, text) of all lines.

    Explodes of computed arrays are outer ones here and below, and what they add is taken out again: below an inner one
    Spark puts a test of the array's size, and computes the array once more for it.
    """
    return docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("doc"), F.posexplode_outer(F.split(text_col, "\n")).alias("line", "text")
    ).where("line is not null")


def simhashes(lines: DataFrame) -> DataFrame:
    """(doc, line, h, g, chars, short, sim, m0, m1, ...): two hashes, length, SimHash and least pair hashes of each line's form.

    short is the form itself, of lines of SHORT characters at most.

    sim has the bits that more than half of the hashes of the line's word pairs have (each word with the next one, the
    last word with nothing). Eight sums count the 64 bits of up to CHUNK pairs, each in a byte of its own; lines of more
    words have several such rows, whose counts are added up bit by bit.
    """
    split = lines.select(
        "doc",
        "line",
        F.xxhash64("form").alias("h"),
        F.xxhash64("form", F.lit(11)).alias("g"),
        F.length("form").alias("chars"),
        F.when(F.length("form") <= SHORT, F.col("form")).alias("short"),
        F.split("form", " ").alias("words"),
    )
    words = split.select("doc", "line", "h", "g", "chars", "short", "words", F.posexplode_outer("words").alias("at", "word"))
    pairs = words.where("word <> ''").select(  # a form without words is one empty word
        "doc", "line", "h", "g", "chars", "short",
        F.expr(f"int(at div {CHUNK})").alias("chunk"),
        F.expr("xxhash64(word, get(words, at + 1))").alias("pair"),
    )
    every_8th = F.lit(0x0101010101010101)
    sums = [F.sum(F.shiftrightunsigned("pair", k).bitwiseAND(every_8th)).alias(f"s{k}") for k in range(8)]
    keys = ["doc", "line", "h", "g", "chars", "short"]
    least = [F.min(F.xxhash64("pair", F.lit(k))).alias(m) for k, m in enumerate(_LEAST)]
    chunks = pairs.groupBy(*keys, "chunk").agg(F.count("*").alias("n"), *sums, *least)
    # lines of one chunk that isn't full are done; the others keep their sums
    chunks = chunks.withColumn("whole", F.expr(f"chunk = 0 and n < {CHUNK}"))
    left = [F.when(~F.col("whole"), F.col(f"s{k}")).alias(f"s{k}") for k in range(8)]
    chunks = chunks.select(*keys, *_LEAST, "n", "whole", F.when(F.col("whole"), _majority_of_bytes()).alias("sim"), *left)
    chunks = materialize(chunks, "chunks")
    counts = [F.shiftrightunsigned(f"s{at % 8}", at - at % 8).bitwiseAND(F.lit(0xFF)) for at in range(64)]
    totals = [F.sum(c).alias(f"c{at}") for at, c in enumerate(counts)]
    long = chunks.where("not whole").groupBy(*keys).agg(F.sum("n").alias("n"), *totals, *[F.min(m).alias(m) for m in _LEAST])
    long = materialize(long.select(*keys, *_LEAST, _majority([F.col(f"c{at}") for at in range(64)]).alias("sim")), "long")
    return chunks.where("whole").select(*keys, *_LEAST, "sim").unionByName(long)


def _majority_of_bytes() -> Column:
    """The bits whose counts, which are the bytes of s0 to s7, are more than half of n (CHUNK at most).

    All counts of a column are compared at once: in lanes of 16 bits, a count and 255 - n / 2 reach 256 if it is more.
    """
    lane = 0x0001000100010001
    lack = (F.lit(255) - F.shiftright("n", 1)) * F.lit(lane)
    sim = F.lit(0).cast("long")
    for k in range(8):
        for part in (0, 8):
            count = F.shiftrightunsigned(f"s{k}", part).bitwiseAND(F.lit(0xFF * lane))
            bits = F.shiftrightunsigned(count + lack, 8).bitwiseAND(F.lit(lane))
            sim = sim.bitwiseOR(F.shiftleft(bits, k + part))
    return sim


def _majority(counts: list[Column]) -> Column:
    """The bits whose counts are more than half of n."""
    sim = F.lit(0).cast("long")
    for at, count in enumerate(counts):
        bit = (1 << at) - (1 << 64 if at == 63 else 0)
        sim = sim.bitwiseOR(F.when(2 * count > F.col("n"), F.lit(bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return sim


def _blocks(sim: str) -> list[Column]:
    return [F.shiftrightunsigned(sim, k * WIDTH).bitwiseAND((1 << WIDTH) - 1) for k in range(BLOCKS)]


def _without_one(form: Column, similarity: float) -> Column:
    """Keys of a form: all of it, and what is left without each of its words (letters, if it is a single word).

    A long word can't be replaced by any other, so without it the form only meets those that have its first or last letters
    there.
    """
    units = F.when(F.contains(form, F.lit(" ")), F.split(form, " ")).otherwise(F.split(form, ""))
    most = F.lit(1 / similarity - 1) * F.length(form)  # of the longer one's characters that may change
    rest = lambda i: F.concat(F.slice(units, F.lit(1), i), F.slice(units, i + 2, F.length(form)))
    any_word = F.transform(units, lambda x, i: F.when(F.length(x) <= F.greatest(most, F.lit(1)), F.xxhash64(F.lit(0), rest(i))))
    long = lambda x, key: F.when(2 * F.length(x) > most, key)
    begin = F.transform(units, lambda x, i: long(x, F.xxhash64(F.lit(1), F.left(x, F.lit(2)), rest(i))))
    end = F.transform(units, lambda x, i: long(x, F.xxhash64(F.lit(2), F.right(x, F.lit(2)), rest(i))))
    like_it = [F.when(F.contains(form, F.lit(" ")), x).otherwise(F.array().cast("array<bigint>")) for x in (begin, end)]
    return F.array_distinct(F.array_compact(F.concat(F.array(F.xxhash64(F.lit(0), units)), any_word, *like_it)))


def _near(s: str, t: str, m: str, n: str, similarity: float) -> Column:
    few = (F.bit_count(F.col(s).bitwiseXOR(F.col(t))) <= FAR) | (F.greatest(m, n) <= SHORT)
    return few & (F.least(m, n) >= F.lit(similarity) * F.greatest(m, n))


def _verified(pairs: DataFrame, forms: DataFrame, docs: DataFrame, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) of forms that have the edit similarity."""
    wanted = materialize(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "wanted")
    places = materialize(forms.join(small(wanted), "id", "left_semi").select("id", "doc", "line"), "places")
    ids = materialize(places.select(F.col("doc").alias(id_col)).distinct(), "ids")
    texts = _lines(docs.join(small(ids), id_col, "left_semi"), id_col, text_col)
    texts = texts.join(small(places), ["doc", "line"]).groupBy("id").agg(F.max("text").alias("text"))
    texts = materialize(texts.select("id", normal_form(F.col("text")).alias("form")), "texts")
    side = lambda x: texts.select(F.col("id").alias(x), F.col("form").alias(f"form_{x}"))
    # rows are few bytes and much work: deal them by number, or they would be put together by size
    both = pairs.join(side("a"), "a").repartition(max(1, pairs.count() // PAIRS), "b").join(side("b"), "b")
    longer = F.greatest(F.length("form_a"), F.length("form_b"))
    both = both.withColumn("most", F.floor(F.lit(round(1 - similarity, 6)) * longer + 1e-9).cast("int"))
    # what both begin and end with doesn't count: the distance is that of the words between
    both = both.withColumns({f"words_{x}": F.split(f"form_{x}", " ") for x in "ab"})
    differ = lambda a, b: F.array_position(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), True) - 1
    both = both.withColumn("begin", differ(F.col("words_a"), F.col("words_b")))
    end = F.least(differ(F.reverse("words_a"), F.reverse("words_b")), F.least(F.size("words_a"), F.size("words_b")) - F.col("begin"))
    both = both.withColumn("end", end)
    both = both.withColumns({f"words_{x}": F.expr(f"slice(words_{x}, int(begin + 1), int(size(words_{x}) - begin - end))") for x in "ab"})
    both = both.withColumns({f"mid_{x}": F.concat(F.array_join(f"words_{x}", " "), F.lit(" ")) for x in "ab"})
    # distances of three ways from one to the other, which the least one isn't above, and quick to find: all the words
    # between, word by word, and in long lines piece by piece; then the least one, as far as it is at most `most`
    whole = F.greatest(F.length("mid_a"), F.length("mid_b"))
    total = lambda parts: F.aggregate(parts, F.lit(0), lambda n, x: n + x)
    word = lambda x, y: F.when(x == y, 0).otherwise(F.greatest(F.length(x), F.length(y)))
    by_word = F.when(F.size("words_a") == F.size("words_b"), total(F.zip_with("words_a", "words_b", word)))
    pieces = [F.expr(f"transform(sequence(0, length(mid_{x}) div {PIECE}), i -> substring(mid_{x}, i * {PIECE} + 1, {PIECE}))") for x in "ab"]
    by_piece = F.zip_with(*pieces, lambda x, y: F.levenshtein(F.coalesce(x, F.lit("")), F.coalesce(y, F.lit(""))))
    near = F.when(whole <= F.col("most"), True).when(by_word <= F.col("most"), True)
    # most lines that are near are so by far, and a narrow band tells it soon
    for part in (16, 4):
        near = near.when(F.expr(f"levenshtein(mid_a, mid_b, most div {part}) >= 0"), True)
    near = near.when((whole > PIECEWISE) & (total(by_piece) <= F.col("most")), True)
    near = near.when(F.expr("levenshtein(mid_a, mid_b, most) >= 0"), True)
    tried = materialize(both.select("a", "b", near.otherwise(False).alias("near")), "tried")
    discard(wanted, places, ids, texts)
    return tried.where("near").select("a", "b")


def line_groups(
    docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """(lines, kept): lines with a word (doc, line, h, g); for each form (h, g) of several lines its group's first place."""
    lines = _lines(docs, id_col, text_col).select("doc", "line", normal_form(F.col("text")).alias("form"))
    lines = simhashes(lines)  # a line without a word has an empty form
    forms = lines.groupBy("h", "g", "short").agg(
        F.min(F.struct("doc", "line")).alias("at"),
        F.count("*").alias("n"),
        F.max("sim").alias("sim"),
        F.max("chars").alias("chars"),
        *[F.max(m).alias(m) for m in _LEAST],
    )
    forms = materialize(
        forms.select(F.monotonically_increasing_id().alias("id"), "h", "g", "at.doc", "at.line", "n", "sim", "chars", "short", *_LEAST), "forms"
    )
    block = _blocks("sim")
    keys = []
    for n, chosen in enumerate(combinations(range(BLOCKS), KEPT)):
        key = F.lit(n).cast("long")
        for k in chosen:
            key = F.shiftleft(key, WIDTH).bitwiseOR(block[k])
        keys.append(key)
    for n, (a, b) in enumerate(combinations(_LEAST, 2)):  # below 0, and keys of blocks are above
        keys.append(F.xxhash64(F.lit(n), a, b).bitwiseOR(F.lit(-(1 << 63)).cast("long")))
    # one shuffle of (key, id); counts and the join that follow find it dealt by key
    of_short = F.transform(_without_one(F.col("short"), similarity), lambda k: k.bitwiseOR(F.lit(-(1 << 63)).cast("long")))
    keys = F.concat(F.array(*keys), F.coalesce(of_short, F.array().cast("array<bigint>")))
    keyed = forms.select("id", F.explode_outer(keys).alias("key")).repartition("key")
    # few keys have several forms, so those are hashed and the many rows of keyed needn't be sorted
    met = keyed.groupBy("key").agg(F.min("id").alias("lead"), F.count("*").alias("k")).where("k > 1").select("key", "lead")
    meetings = materialize(keyed.join(met.hint("shuffle_hash"), "key"), "meetings")
    of = lambda x, name: forms.select(F.col("id").alias(name), F.col("sim").alias(f"sim_{x}"), F.col("chars").alias(f"chars_{x}"))
    known = materialize(meetings.join(of("a", "id"), "id"), "known")
    discard(meetings)
    starred = materialize(
        known.where("id <> lead")
        .groupBy("id", "lead", "sim_a", "chars_a")
        .agg(F.count("*").alias("n_keys"))
        .join(of("b", "lead"), "lead")
        .where(_near("sim_a", "sim_b", "chars_a", "chars_b", similarity))
        .groupBy(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b"))
        .agg(F.sum("n_keys").alias("n_keys")),
        "starred",
    )
    # first one leader for each form, the one it meets most often; then those that this hasn't brought together
    first = starred.groupBy("b").agg(F.max_by("a", F.struct("n_keys", -F.col("a"))).alias("a")).select("a", "b")
    first = materialize(first, "first")
    links = _verified(first, forms, docs, similarity, id_col, text_col)
    label = components(links).withColumnsRenamed({"node": "id", "component": "group"})
    group = lambda x: label.select(F.col("id").alias(x), F.col("group").alias(f"group_{x}"))
    apart = starred.select("a", "b").join(first, ["a", "b"], "left_anti").join(group("a"), "a", "left").join(group("b"), "b", "left")
    apart = materialize(apart.where(F.coalesce("group_a", "a") != F.coalesce("group_b", "b")).select("a", "b"), "apart")
    if not apart.isEmpty():
        links = links.unionByName(_verified(apart, forms, docs, similarity, id_col, text_col))
        label = components(links).withColumnsRenamed({"node": "id", "component": "group"})
    placed = known.drop("lead").join(label, "id", "left").withColumn("group", F.coalesce("group", "id"))
    placed = materialize(placed, "placed")
    discard(known)
    mixed = placed.groupBy("key").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).where("lo < hi").select("key")
    apart = placed.drop("group").join(mixed, "key").join(forms.select("id", *_LEAST), "id")
    length = F.log("chars_a") / -math.log(similarity)  # lines of similar lengths are in one class, or in one of those half a class on
    traits = [*_blocks("sim_a"), *_LEAST, F.floor(length), F.floor(length + 0.5)]
    finer = [F.xxhash64("key", F.lit(k), t) for k, t in enumerate(traits)]
    finer = apart.select("id", F.explode(F.array(*finer)).alias("finer")).repartition("finer")
    leads = finer.groupBy("finer").agg(F.min("id").alias("lead"), F.count("*").alias("k")).where("k > 1").select("finer", "lead")
    led = finer.join(leads.hint("shuffle_hash"), "finer").where("id <> lead").select("id", "lead").distinct()
    led = materialize(led, "led")
    side = lambda x, name: of(x, name).join(group(x), F.col(name) == F.col(x), "left").drop(x)
    more = (
        led.join(side("a", "id"), "id")
        .join(side("b", "lead"), "lead")
        .where(F.coalesce("group_a", "id") != F.coalesce("group_b", "lead"))
        .where(_near("sim_a", "sim_b", "chars_a", "chars_b", similarity))
        .select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b"))
        .distinct()
    )
    more = materialize(more.join(starred.select("a", "b"), ["a", "b"], "left_anti"), "more")
    discard(placed, led)
    if not more.isEmpty():
        links = links.unionByName(_verified(more, forms, docs, similarity, id_col, text_col))
        label = components(links).withColumnsRenamed({"node": "id", "component": "group"})
    # a form that stands in one line and in no group keeps it
    found = label.select("id", "group").unionByName(label.select(F.col("group").alias("id"), "group").distinct())
    grouped = forms.join(materialize(found, "found"), "id", "left").where("n > 1 or group is not null")
    grouped = materialize(grouped.select("h", "g", "doc", "line", F.coalesce("group", "id").alias("group")), "grouped")
    first = grouped.groupBy("group").agg(F.min(F.struct("doc", "line")).alias("kept"))
    return lines.select("doc", "line", "h", "g"), grouped.join(first, "group").select("h", "g", "kept")


def dropped_lines(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, dropped): the numbers of the lines of each document that another occurrence stands for, ascending."""
    lines, kept = line_groups(docs, similarity, id_col, text_col)
    gone = lines.join(kept, ["h", "g"]).where("struct(doc, line) <> kept")
    return gone.groupBy("doc").agg(F.array_sort(F.collect_set("line")).alias("dropped"))


def dedup_lines(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the texts' repeated lines taken out; other columns and rows stay."""
    doc, dropped = unused(docs, "_doc"), unused(docs, "_dropped")
    gone = materialize(dropped_lines(docs, similarity, id_col, text_col), "dropped").withColumnsRenamed({"doc": doc, "dropped": dropped})
    left = F.array_join(F.filter(F.split(text_col, "\n"), lambda _, i: ~F.array_contains(dropped, i)), "\n")
    joined = docs.join(gone, docs[id_col] == F.col(doc), "left")
    return joined.withColumn(text_col, F.when(F.col(doc).isNull(), F.col(text_col)).otherwise(left)).select(*docs.columns)
