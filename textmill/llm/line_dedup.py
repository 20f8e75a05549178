"""Line dedup by a log-template tree of fixed depth, in DataFrame operations only.

A line's tokens are its parts between white space; each character of a script that is written
without blanks (Chinese, Japanese, Thai, Lao, Khmer, Burmese) is a token.  A token with a digit,
an at sign or ``://`` is a variable field and reads ``<*>``.  The tree has a level for the number of
tokens and one for each of the ``depth`` leading tokens; a leaf's lines are alike in those.

A leaf's templates are found in rounds.  A group's template has, at each position, the token that
more than half of its distinct lines have, else ``<*>``; a line belongs to it if at least
``similarity`` of its tokens are equal to the template's.  The lines that fit none are parted by the
token, of those that at most half of them have, that most of them have in common with the line,
and each part is a group of the next round.  A line that hasn't
``similarity`` of its tokens in common with others of its group can't fit any template but its own.
Every round takes lines out or makes groups smaller, so rounds end by themselves.

A template recurs if lines of it are in more than one document.  Its lines are dropped from
all documents but the first (smallest key), which keeps them, so that no text is lost from
the collection.  Lines of fewer than ``alike_from`` tokens are too short to be told apart by
shares of equal tokens: each is a template as it stands, digits included, so only exact repeats
of it are dropped.  Blank lines are left alone, and so are those of fewer than ``min_tokens`` tokens
where that is set above 1.

Lines are moved as hashes, but for those whose leaf is in several documents, which a bit array
of fixed size (``bits``) tells from most others before the shuffle.  Equal lines of a leaf are
combined before they meet, so a line that a third of all documents share costs each task one
row.  The final join moves each text once.

Defined results: a null or empty text has no lines to drop and stays as it is; rows that are
equal in key and text are one document and get equal results; a null key sorts first; an
empty table gives an empty result; all other columns are kept, but those called like the
added ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .common import bloom, maybe

ADDED = ("n_lines", "n_dropped", "n_left")
FIELD = "<*>"


#: White space but line feeds, and letters of scripts without blanks between words.
_SPACE = r"\t\x0B-\r\x85\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
_DENSE = r"\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3005-\u3007\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\x{20000}-\x{3FFFF}"
#: A few ranges that hold all of these beyond ASCII; far cheaper to search for.
_BEYOND = r"[\u0085\u00A0\u0E00-\x{10FFFF}]"


def spaced(text: Column) -> Column:
    """The text with one blank between any two tokens of a line; its line feeds stay."""
    # Searches for single bytes are far cheaper than expressions, which only texts beyond ASCII need.
    odd = (F.octet_length(text) > F.length(text)) & text.rlike(_BEYOND) & text.rlike(f"[{_SPACE}{_DENSE}]")
    for part in ("  ", "\t", "\r", "\x0b", "\x0c"):
        odd = F.contains(text, F.lit(part)) | odd
    return F.when(odd, F.regexp_replace(F.regexp_replace(text, f"([{_DENSE}])", " $1 "), f"[ {_SPACE}]+", " ")).otherwise(text)


def masked_line(line: Column) -> Column:
    """The trimmed line with its variable fields generalised."""
    line = F.when(F.contains(line, F.lit("://")), F.regexp_replace(line, "(?<![^ ])[^ ]*://[^ ]*", FIELD)).otherwise(line)
    return F.when(line.rlike("[0-9@]"), F.regexp_replace(line, "(?<![^ ])[^ 0-9@]*+[0-9@][^ ]*", FIELD)).otherwise(line)


def n_tokens(line: Column) -> Column:
    """Tokens of a spaced and trimmed line."""
    return F.when(line == "", 0).otherwise(F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1)


def blank(line: Column) -> Column:
    """Whether a line is nothing but white space; the first character tells for most lines."""
    first = F.ascii(line)
    return ((first <= 32) | (first >= 127)) & ~line.rlike(r"(?U)\S")


def placed(masked: Column) -> Column:
    """Tokens of a masked line, each with its position."""
    return F.transform(F.split(masked, " "), lambda t, i: F.concat(i.cast("string"), F.lit(" "), t))


def lines_of(docs: DataFrame, text: str, depth: int, min_tokens: int, alike_from: int) -> DataFrame:
    """Rows (__key, __id, line_no, masked, leaf, line_hash) of the lines that the tree holds."""
    lines = docs.select("__key", "__id", F.posexplode(F.split(spaced(F.col(text)), "\n")).alias("line_no", "line"))
    lines = lines.withColumn("line", F.trim("line")).where("line != ''").withColumn("n", n_tokens(F.col("line")))
    if min_tokens > 1:
        lines = lines.where(F.col("n") >= min_tokens)
    # Fields are generalised token by token, so the leading ones tell the leaf, and a filter on leaves
    # spares the others' lines the patterns.
    masked, leading = (
        F.when(F.col("n") < alike_from, F.col("line")).otherwise(masked_line(part)) for part in (F.col("line"), F.substring_index("line", " ", depth))
    )
    lines = lines.select("__key", "__id", "line_no", masked.alias("masked"), F.xxhash64("n", leading).alias("leaf"))
    return lines.withColumn("line_hash", F.xxhash64("leaf", "masked"))


def templates(lines: DataFrame, slim: DataFrame, depth: int, similarity: float, bits: int) -> DataFrame:
    """Rows (line_hash, first) of every line of a recurring template; first is its first document.

    ``slim`` has the lines without their texts.
    """
    who = F.struct("__key", "__id")
    # Whether documents differ is told by hashes, which need no sort as structs would.
    doc = F.xxhash64(F.struct("__key"), "__id", F.col("__key").isNull())
    recurring = slim.groupBy("leaf").agg(F.min(doc).alias("h1"), F.max(doc).alias("h2")).where("h1 != h2").select("leaf").checkpoint()
    # Most lines of other leaves stay where they are; the join settles the rest.
    words = bloom(recurring, "leaf", bits).scalar()
    inside = lines.where(maybe(words, F.col("leaf"), bits)).join(recurring.hint("shuffle_hash"), "leaf")
    # A hash of the leaf, so that equal lines are combined before they are dealt out anew.
    left = (
        inside.select(F.xxhash64(F.col("leaf"), F.lit(1)).alias("group"), "masked", "line_hash", who.alias("who"))
        .groupBy("line_hash", "group", "masked").agg(F.min("who").alias("first"), F.max("who").alias("last"))
        .checkpoint()
    )
    judged = None
    while True:
        round_ = judge_groups(left, similarity).checkpoint()
        done = round_.where("shared or alone").select("line_hash", "first", "last", F.when(F.col("shared"), F.col("group")).otherwise(F.col("line_hash")).alias("tid"), "shared")
        judged = done if judged is None else judged.union(done)
        left = regrouped(round_.where("not shared and not alone"), depth, similarity).checkpoint()
        own = left.where("alone")
        judged = judged.union(own.select("line_hash", "first", "last", F.col("line_hash").alias("tid"), F.lit(False).alias("shared")))
        left = left.where("not alone").drop("alone")
        if left.isEmpty():
            break
    ends = judged.groupBy("tid", "shared").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    ends = ends.where(~F.col("first").eqNullSafe(F.col("last"))).drop("last")
    return judged.select("line_hash", "tid", "shared").join(ends.hint("shuffle_hash"), ["tid", "shared"]).select("line_hash", "first")


def judge_groups(lines: DataFrame, similarity: float) -> DataFrame:
    """The lines with shared (they belong to their group's template) and alone (nothing else is in the group)."""
    sizes = lines.groupBy("group").agg(F.count("*").alias("n")).where("n > 1")
    at = lines.join(sizes.hint("shuffle_hash"), "group").select("group", "n", F.explode(placed(F.col("masked"))).alias("token"))
    common = at.groupBy("group", "n", "token").agg(F.count("*").alias("c")).where(F.col("c") * 2 > F.col("n"))
    tree = common.groupBy("group").agg(F.collect_list("token").alias("template"))
    equal = F.size(F.array_intersect(placed(F.col("masked")), "template"))
    shared = F.coalesce(equal >= F.lit(similarity) * n_tokens(F.col("masked")), F.lit(False))
    return lines.join(tree.hint("shuffle_hash"), "group", "left").select(*lines.columns, shared.alias("shared"), F.col("template").isNull().alias("alone"))


def regrouped(lines: DataFrame, depth: int, similarity: float) -> DataFrame:
    """The lines in groups of the next round; alone are those that share too few tokens with their present group.

    Of the leading tokens, which all lines of a group share, one is counted for all; its count is the group's size.
    """
    tokens = F.transform(F.split("masked", " "), lambda t, i: F.when((i == 0) | (i >= depth), F.concat(i.cast("string"), F.lit(" "), t)))
    at = lines.select("group", "line_hash", F.explode(F.array_compact(tokens)).alias("token"))
    counts = at.groupBy("group", "token").agg(F.count("*").alias("c")).where("c > 1")
    met = at.join(counts, ["group", "token"]).groupBy("line_hash").agg(F.sort_array(F.collect_list(F.struct("c", "token")), asc=False).alias("met"))
    size = F.get("met", F.lit(0))["c"]
    some = F.filter("met", lambda m: m["c"] * 2 <= size)
    most = F.filter("met", lambda m: (m["c"] * 2 > size))
    n = n_tokens(F.col("masked"))
    enough = F.coalesce(F.size("met") + F.least(n, F.lit(depth)) - 1 >= F.lit(similarity) * n, F.lit(False))
    rest = F.size(most) + F.least(n, F.lit(depth)) - 1 >= F.lit(similarity) * n
    part = F.when(rest, F.lit("")).otherwise(F.get(some, F.lit(0))["token"])
    joined = lines.join(met.hint("shuffle_hash"), "line_hash", "left")
    return joined.select(F.xxhash64("group", part).alias("group"), "masked", "line_hash", "first", "last", (~enough).alias("alone"))


def dedup_lines(
    docs: DataFrame, key: str = "doc_id", text: str = "text", depth: int = 3, similarity: float = 0.7, min_tokens: int = 1, bits: int = 1 << 23,
    alike_from: int = 5,
) -> DataFrame:
    """All rows; ``text`` without the dropped lines, then n_lines, n_dropped and n_left.

    n_left counts the lines left that have ``min_tokens`` tokens or more; with 1, all but blank ones.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))  # out of the way of the columns below
    named = docs.select(row.alias("row"), F.col(key).alias("__key"), F.xxhash64(F.lit(7), F.col(text)).alias("__id"), F.col(text).alias("text"))
    lines = lines_of(named.select("__key", "__id", "text"), "text", depth, min_tokens, alike_from)
    ensure_checkpoint_dir(docs.sparkSession)
    slim = lines.select("__key", "__id", "line_no", "leaf", "line_hash").checkpoint()
    found = templates(lines, slim, depth, similarity, bits)
    hit = slim.drop("leaf").join(found, "line_hash").where(~F.struct("__key", "__id").eqNullSafe(F.col("first")))
    drops = hit.groupBy("__key", "__id").agg(F.collect_set("line_no").alias("drop"))
    drops = drops.select(F.col("__key").alias("k2"), F.col("__id").alias("i2"), "drop")
    same = F.col("__key").eqNullSafe(F.col("k2")) & (F.col("__id") == F.col("i2"))
    parts = F.split(F.col("text"), "\n")
    kept = F.filter(parts, lambda line, i: ~F.array_contains(F.col("drop"), i))
    joined = named.join(drops.hint("shuffle_hash"), same, "left").withColumn("kept", F.when(F.col("drop").isNull(), parts).otherwise(kept))
    left = F.filter(F.col("kept"), lambda line: ~blank(line) if min_tokens <= 1 else n_tokens(F.trim(spaced(line))) >= min_tokens)
    out = {c: F.col("row").getField(c) for c in docs.columns if c not in ADDED}
    out[text] = F.when(F.col("drop").isNull(), F.col("text")).otherwise(F.array_join("kept", "\n"))
    return joined.select(
        *(e.alias(c) for c, e in out.items()),
        F.coalesce(F.size(parts), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"),
        F.coalesce(F.size(left), F.lit(0)).cast("long").alias("n_left"),
    )
