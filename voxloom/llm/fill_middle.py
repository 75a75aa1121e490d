"""Fill-in-the-middle examples, with texts cut into units by zero-width boundaries.

A grammar lists kinds of units.  It is translated to a regular expression that
matches the empty string between two neighbouring characters exactly where one
unit ends and the next begins: a look behind at the left neighbour's class and
a look ahead at the right one's.  ``split`` on it keeps every piece, so the
pieces of a text join to the text again.  Two hashed positions then cut the
pieces into prefix, middle and suffix.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_MARK = "<[PSM]>"


@dataclass(frozen=True)
class Unit:
    """Units made of the characters of ``of`` (the inside of a regular expression's brackets; empty for all the rest).

    ``each``: every character is a unit.  ``run``: the longest runs are units.
    ``ends``: a unit goes up to such a character and includes it.
    """

    of: str
    kind: str = "run"


#: Every code point is a unit.
CODE_POINTS = (Unit("", "each"),)
#: Words, and the white space between them.
WORDS = (Unit(r"\x20\x09-\x0D", "run"), Unit("", "run"))
#: Lines with their line ends.
LINES = (Unit(r"\n", "ends"), Unit("", "run"))


def boundary(grammar: tuple[Unit, ...]) -> str:
    """The zero-width expression for ``grammar``; a character belongs to the first kind that names it.

    A dot reads a whole code point on either side, so no boundary falls inside
    a surrogate pair, at the start or at the end of a text.
    """
    cuts, seen = [], ""
    ending = [u.of for u in grammar if u.kind == "ends"]
    for unit in grammar:
        # What a kind without a class of its own holds is all that the kinds before it do not name.
        mine = f"[{unit.of}{f'&&[^{seen}]' if seen else ''}]" if unit.of else (f"[^{seen}]" if seen else ".")
        other = f"(?!{mine})(?=.)"
        if unit.kind in ("each", "ends"):
            cuts.append(f"(?<={mine})(?=.)")
        elif not unit.of and ending:
            # Characters that lead up to an end belong to its unit.
            cuts.append(f"(?<={mine}){other}(?![{''.join(ending)}])")
        else:
            cuts.append(f"(?<={mine}){other}")
        seen += unit.of
    return "(?s)" + "|".join(cuts)


def pieces(text: Column, grammar: tuple[Unit, ...] = CODE_POINTS) -> Column:
    """The units of a text in order; none for null and empty texts, of which ``split`` would make one empty piece."""
    none = F.array().cast("array<string>")
    return F.when(F.length(text) > 0, F.split(text, boundary(grammar), -1)).otherwise(none)


def hashed(seed: int) -> list[Column]:
    """h1 to h4: the first four groups of 8 hex digits of the SHA-256 of ``seed:doc_id``; a null id counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, grammar: tuple[Unit, ...] = CODE_POINTS, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """doc_id, n, form, prefix, middle, suffix, output: one row per row of ``docs``.

    ``n`` counts units.  The prefix ends after the smaller of h1 % (n + 1) and
    h2 % (n + 1) units, the middle after the larger.  ``form`` is ``plain``
    where the text is empty or null, where it holds a marker, and for
    ``plain_percent`` of all ids; then ``output`` is the text and the parts
    are null.  Of the others ``spm_percent`` are ``spm`` (suffix first), the
    rest ``psm``.  Rows of equal id are cut by the same hash; repeated rows
    give repeated rows; other columns are ignored; an empty table gives none.

    One narrow pass without a shuffle; a task holds the pieces of one text.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    h1, h2, h3, h4 = hashed(seed)

    # Pieces and positions are columns of their own: the optimizer keeps apart what is read several times.
    rows = rows.withColumn("pieces", pieces(F.col("text"), grammar)).withColumn("n", F.size("pieces").cast("long"))
    ends = F.array(F.pmod(h1, F.col("n") + 1), F.pmod(h2, F.col("n") + 1))
    rows = rows.withColumn("low", F.array_min(ends).cast("int")).withColumn("high", F.array_max(ends).cast("int"))
    part = lambda begin, end: F.array_join(F.slice("pieces", begin + 1, end - begin), "")
    low, high, n = F.col("low"), F.col("high"), F.col("n").cast("int")
    parts = {"prefix": part(F.lit(0), low), "middle": part(low, high), "suffix": part(high, n)}
    plain = (F.col("n") == 0) | F.col("text").rlike(_MARK) | (h3 % 100 >= 100 - plain_percent)
    form = F.when(plain, "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm")
    rows = rows.withColumn("form", form)
    rows = rows.select("doc_id", "n", "form", "text", *[F.when(F.col("form") != "plain", c).alias(k) for k, c in parts.items()])
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text"))
    return rows.select("doc_id", "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that was cut, from ``output`` and ``form`` alone: no part holds a marker, and none can arise where two parts meet."""
    joined = lambda p: F.when(form == "psm", F.concat(p[1], p[3], p[2])).otherwise(F.concat(p[2], p[3], p[1]))
    return F.when(form == "plain", output).otherwise(F.transform(F.array(F.split(output, _MARK, -1)), joined)[0])


def digests(examples: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 of ``fill_in_middle``'s rows."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return examples.select(
        "doc_id",
        "n",
        "form",
        F.length("prefix").cast("long").alias("prefix_chars"),
        F.length("middle").cast("long").alias("middle_chars"),
        sha(F.col("output")).alias("output_sha256"),
        sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )
