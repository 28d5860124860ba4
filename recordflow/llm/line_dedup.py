"""Line dedup by an exact set-similarity join, in DataFrame functions alone.

A line is the set of its tokens (between white space, in lower case). Each token has a number that begins with how
often the cell that it hashes to occurs in the corpus (a table of `CELLS` numbers, so its size is bounded) and ends with
its hash, so numbers in order are tokens by rarity. Any fixed order makes the filters exact; rarity makes them sharp.
Lines with equal sets are collapsed to the first of them. Linked sets share a token among the first
n - ceil(t * n) + 1 of each, so these are joined; the pair must also pass the length filter, the positional filter
(the shared token's places bound the overlap) and a bitmap filter (sets differ in at least as many tokens as their
64-bit parities differ in bits). What is left is verified on the tokens themselves. A line goes if a line before it,
in order of (doc_id, line number), has Jaccard >= t with it.

One earlier match is enough, so a token's sets aren't all paired. The set that most lines have is the token's hub,
and a later set that the filters let be linked with the hub is paired in that token with the hub alone. Only where
that comes to nothing in every token are the set's other earlier partners tried. So near copies of one line make
pairs in proportion to their number. A set too small to link with any other has no tokens to join.

Defined cases: a null text counts as empty; an empty text is one empty line. Lines without tokens always
stay. Rows without identifier come first in order, together with an identifier that is the smallest long. Rows that
share an identifier count as one document with all their lines; equal line numbers are ties, and the lines of a tie
don't remove each other unless their sets are equal and a line before has them too. Lines of any length are
compared whole. Columns of docs other than the two named may have any name; dedup() gives them back. An empty
table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, table

CELLS = 1 << 16
SMALL = 1_000_000  # rows of an explicitly broadcast side, at most: three numbers each


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line_no from 0, line in lower case)"""
    return _texts(docs, id_col, text_col).select("doc_id", F.posexplode(F.split(F.lower("text"), "\n")).alias("line_no", "line"))


def words(text: Column) -> Column:
    """What stands between white space in a line; also empty texts, where more than a blank does. Most have blanks alone, which is split faster."""
    other = reduce(lambda a, b: a | b, [F.contains(text, F.lit(c)) for c in "\t\r\x0b\x0c"])
    return F.when(other, F.split(text, r"\s+")).otherwise(F.split(text, " "))


def _constant(numbers: list[int]) -> Column:
    """An array that is put in place once."""
    return F.expr(f"cast(split('{','.join(map(str, numbers))}', ',') as array<bigint>)")


def _cell(h: Column) -> Column:
    return h.bitwiseAND(F.lit(CELLS - 1))


def rarity(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """An array with a number for each cell, which grows with the number of its tokens, two steps a doubling: the highest byte of a long, where 126 is beyond any count."""
    text = F.replace(F.lower("text"), F.lit("\n"), F.lit(" "))
    tokens = _texts(docs, id_col, text_col).select(text.alias("text")).select(F.explode(words(F.col("text"))).alias("word"))
    counts = tokens.groupBy(_cell(F.xxhash64("word")).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    rank = F.least(F.lit(126), F.round(F.log2(F.col("n") + 1) * 2)).cast("int")
    part = F.array_join(F.collect_list(F.concat_ws(" ", "cell", rank)), " ")
    numbers = " ".join(r[1] for r in counts.groupBy(F.shiftright("cell", 10)).agg(part).collect()).split()  # at most CELLS cells
    held = [0] * CELLS
    for cell, r in zip(numbers[::2], numbers[1::2], strict=True):
        held[int(cell)] = int(r) << 56
    return _constant(held)


def _hashes(text: Column) -> Column:
    """The hashes of the distinct tokens. Where this is a column of its own, only the tokens' hashes are interpreted."""
    return F.array_remove(F.array_distinct(F.transform(words(text), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))


def _numbers(hashes: Column, ranks: Column) -> Column:
    """The numbers of distinct tokens, the rarest first: the cell's rank, then 56 bits of the hash. None is null, so they are sorted as plain longs."""

    def number(h: Column) -> Column:
        return F.coalesce(ranks[_cell(h)], F.lit(0)).bitwiseXOR(F.shiftrightunsigned(h, 8))

    return F.sort_array(F.transform(hashes, number))


def _parity(numbers: Column) -> Column:
    """Bit i is set if an odd number of the numbers end with i. The bits are looked up: each operation in here is interpreted."""
    bits = _constant([*(1 << i for i in range(63)), -(1 << 63)])
    return F.aggregate(numbers, F.lit(0).cast("bigint"), lambda acc, x: acc.bitwiseXOR(bits[x.bitwiseAND(F.lit(63))]))


def _before(a: str, b: str) -> Column:
    return (F.col(f"d{a}") < F.col(f"d{b}")) | ((F.col(f"d{a}") == F.col(f"d{b}")) & (F.col(f"l{a}") < F.col(f"l{b}")))


def _close(a: str, b: str, num: int, den: int) -> Column:
    """Whether the filters let the sets be linked."""
    na, nb, pa, pb = (F.col(c) for c in (f"n{a}", f"n{b}", f"p{a}", f"p{b}"))
    need = F.ceil(F.lit(num) * (na + nb) / F.lit(num + den))
    differ = F.bit_count(F.col(f"bits{a}").bitwiseXOR(F.col(f"bits{b}")))
    return (na * num <= nb * den) & (nb * num <= na * den) & (F.least(na - pa, nb - pb) >= need - F.least(pa, pb)) & (differ <= na + nb - 2 * need)


_SET = ("d", "l", "h")  # a set by its first line: document, number, hash of the line


_HELD = (*_SET, "n", "p", "bits", "copies")


def _named(rows: DataFrame, s: str) -> DataFrame:
    return rows.select("token", *[F.col(c).alias(c + s) for c in _HELD])


def _small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= SMALL else df


def _verified(pairs: DataFrame, docs: DataFrame, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """The later sets (d, l, h) of the pairs that are linked, by the lines' own tokens."""
    ends = pairs.select(*[F.col(c + "a").alias(c) for c in _SET]).union(pairs.select(*[c + "b" for c in _SET])).distinct().checkpoint()
    n = ends.count()
    texts = _texts(docs, id_col, text_col).withColumn("d", _order(F.col("doc_id")))
    some = texts.join(_small(ends.select("d").distinct(), n), "d", "left_semi").select("d", F.posexplode(F.split(F.lower("text"), "\n")).alias("l", "line"))
    some = some.withColumn("h", F.xxhash64("line")).join(_small(ends, n), list(_SET), "left_semi")
    some = some.withColumn("tokens", F.array_remove(F.array_distinct(words(F.col("line"))), "")).drop("line").distinct()
    x, y = (some.select(*[F.col(c).alias(c + s) for c in (*_SET, "tokens")]) for s in "ab")
    both = pairs.join(x, [c + "a" for c in _SET]).join(y, [c + "b" for c in _SET])
    shared = F.size(F.array_intersect("tokensa", "tokensb"))
    linked = both.where(den * shared >= num * (F.size("tokensa") + F.size("tokensb") - shared))
    return linked.select(*[F.col(c + "b").alias(c) for c in _SET]).distinct()


def _order(doc_id: Column) -> Column:
    return F.coalesce(doc_id, F.lit(-(1 << 63)))


def _tokens(sets: DataFrame) -> DataFrame:
    return sets.select(*_SET, "n", "bits", "copies", F.posexplode("prefix").alias("p", "token"))


def _later(sets: DataFrame, docs: DataFrame, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """(d, l, h) of each set that links with one that comes first before it does."""
    sets = sets.where("prefix is not null and n is not null and bits is not null")
    rows = _tokens(sets)
    x, y = _named(rows, "a"), _named(rows, "b")
    group = "partition by token order by copiesb desc, db, lb, hb rows between unbounded preceding and current row"
    y = y.select("*", *[F.expr(f"first_value({c}b) over ({group})").alias(c + "h") for c in _HELD])
    y = y.withColumn("tried", _before("h", "b") & _close("h", "b", num, den))
    # filtered and cut alike, with copies, both sides of the join are the same rows, which are shuffled once
    is_hub = reduce(lambda a, b: a & b, [F.col(c + "a") == F.col(c + "h") for c in (*_SET, "copies")])
    ends = [c + s for s in "ab" for c in _SET]
    found = x.join(y, "token").where(_before("a", "b") & _close("a", "b", num, den) & (~F.col("tried") | is_hub))
    found = table(found.groupBy(*ends).agg(F.bool_or("tried").alias("tried")), "line-pairs")
    matched = table(_verified(found.drop("tried"), docs, num, den, id_col, text_col), "line-matches")
    # tried with the hub of some token, and with nothing else there
    rest = found.where("tried").select(*[F.col(c + "b").alias(c) for c in _SET]).distinct().join(matched, list(_SET), "left_anti").checkpoint()
    n = rest.count()
    if not n:
        return matched
    again = _tokens(sets.join(_small(rest, n), list(_SET), "left_semi")).checkpoint()
    more = x.join(_small(_named(again, "b"), 4 * again.count()), "token").where(_before("a", "b") & _close("a", "b", num, den))
    more = table(more.select(*ends).distinct(), "line-pairs")
    return matched.union(_verified(more, docs, num, den, id_col, text_col))


def decide(docs: DataFrame, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line_no, removed) of each line."""
    rows = lines(docs, id_col, text_col).withColumn("hashes", _hashes(F.col("line")))
    # two uses keep the hashes a column of their own
    rows = rows.withColumns({"numbers": _numbers(F.col("hashes"), rarity(docs, id_col, text_col)), "n": F.size("hashes")})
    some = F.col("n") * (den - num) >= num  # else no other set is near enough
    prefix = F.slice("numbers", F.lit(1), F.col("n") - F.ceil(F.col("n") * F.lit(num) / F.lit(den)).cast("int") + 1)
    parity = _parity(F.col("numbers"))
    # two hashes of a set's numbers stand for it
    rows = rows.withColumns({"set": F.xxhash64("numbers"), "set2": F.xxhash64(F.lit(2), F.col("numbers")), "h": F.xxhash64("line")})
    every = table(rows.select("doc_id", "line_no", *[F.when(F.col("n") > 0, F.col(c)).alias(c) for c in ("set", "set2", "h")], "n", F.when(some, parity).alias("bits"), F.when(some, prefix).alias("prefix")), "lines")
    keyed = every.where("n > 0").withColumn("d", _order(F.col("doc_id")))
    first = F.min(F.struct("d", F.col("line_no").alias("l"), "h", "n", "bits", "prefix")).alias("first")
    sets = table(keyed.groupBy("set", "set2").agg(first, F.count(F.lit(1)).alias("copies")).select("set", "set2", "first.*", "copies"), "line-sets")
    later = _later(sets, docs, num, den, id_col, text_col).withColumn("all", F.lit(True))
    first = sets.select("set", "set2", *_SET, "copies").join(later, list(_SET), "left").where("copies > 1 or all")
    first = first.select("set", "set2", F.col("d").alias("dh"), F.col("l").alias("lh"), F.coalesce("all", F.lit(False)).alias("all")).checkpoint()
    flat = keyed.select("doc_id", "line_no", "set", "set2", "d", F.col("line_no").alias("l")).join(_small(first, 2 * first.count()), ["set", "set2"], "left")
    after = (F.col("d") > F.col("dh")) | ((F.col("d") == F.col("dh")) & (F.col("l") > F.col("lh")))
    flat = flat.select("doc_id", "line_no", F.coalesce(F.col("all") | after, F.lit(False)).alias("removed"))
    return flat.union(every.where("n = 0").select("doc_id", "line_no", F.lit(False).alias("removed")))


def by_document(docs: DataFrame, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per identifier: doc_id, n_lines, n_removed, removed_lines (their numbers, in order, joined by commas)."""
    gone = F.sort_array(F.collect_list(F.when(F.col("removed"), F.col("line_no"))))
    return decide(docs, num, den, id_col, text_col).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count(F.when(F.col("removed"), 1)).alias("n_removed"), F.array_join(gone.cast("array<string>"), ",").alias("removed_lines"))


def dedup(docs: DataFrame, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the text's removed lines taken out."""
    of, gone = fresh(docs, "gone_id", "gone")
    out = by_document(docs, num, den, id_col, text_col).where("n_removed > 0").select(F.col("doc_id").alias(of), F.split("removed_lines", ",").cast("array<int>").alias(gone))
    kept = F.array_join(F.filter(F.split(F.col(f"`{text_col}`"), "\n"), lambda x, i: ~F.array_contains(gone, i)), "\n")
    text = F.when(F.col(gone).isNull(), F.col(f"`{text_col}`")).otherwise(kept)
    joined = docs.join(out, F.col(f"`{id_col}`").eqNullSafe(F.col(of)), "left")
    return joined.select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
