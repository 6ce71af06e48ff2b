"""Problem 4: one consistent form of text that looks the same.

Compatibility normalisation in composed form, look-alike letters mapped to the
script of their word, white space to single spaces, removal of characters that
are not shown, and, on request, full case folding. Each distinct value of a
batch is mapped once.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageframe.llm._common import map_columns, materialise

# Letters of other scripts and the Latin letters that look like them.
LOOKALIKES = dict(
    zip(
        "АВСЕНІЈКМОРЅТХУаесіјорѕхуԁԛԝһӏ" + "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϲϳ" + "ѵүϱᴄᴏᴠᴡᴢɡɑıẝ",
        "ABCEHIJKMOPSTXYaecijopsxydqwhl" + "ABEZHIKMNOPTYXocj" + "vypcovwzgaif",
    )
)
# Marks that look like an ASCII mark.
MARKS = dict(zip("‐‑⁃﹣－˗۔‚‛ʼ՚＇′ꞌ∶։፡׃⁄∕⧸ǀ∣￨․", "------.,''''''::::///|||."))
_DEFAULT_IGNORABLE = (
    (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164),
    (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
)
_IGNORED = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in _DEFAULT_IGNORABLE) + "\x00-\x08\x0e-\x1f\x7f-\x9f]")
_SPACE = re.compile(r"\s")
# What compatibility normalisation would change although it looks different.
_KEPT = re.compile("[ªº¹²³⁰-⁹ⁱⁿ₀-₉™℠©®½¼¾⅐-⅞…€]+")
_ODD_CHARACTER = re.compile(r"[^\x21-\x7eÀ-ÖØ-öø-ſȘ-ț ]|^ | $")
_LOOKALIKE = re.compile("[" + "".join(LOOKALIKES) + "]")
_MARK = re.compile("[" + re.escape("".join(MARKS)) + "]")
_TOKEN = re.compile(r"\S+")
_LATIN = re.compile(r"[A-Za-zÀ-ɏ]")
#: Rows of one spelling of a line that meet those of another in one task.
PORTION = 20_000


def _latin(m: re.Match) -> str:
    """A token in Latin letters if each of its other letters has a Latin double."""
    token = m.group()
    if not _LOOKALIKE.search(token):
        return token
    changed = "".join(LOOKALIKES.get(c, c) for c in token)
    # a word that keeps a letter of the other script is a word of that script
    return changed if all(not c.isalpha() or _LATIN.match(c) for c in changed) else token


def unify(text: str | None, fold: bool = False, marks: bool = True, trim: bool = True) -> str | None:
    """The text as it is seen, in one spelling; None for null.

    Printable ASCII characters stay as they are, and so does the number of
    spaces. ``fold`` folds case as well, ``marks`` maps hyphens, quotes and
    strokes to their ASCII doubles, ``trim`` drops spaces at both ends.
    A text of unseen characters only gives "". Applying it twice changes nothing.
    """
    if text is None:
        return None
    if _ODD_CHARACTER.search(text):
        for _ in range(3):  # until nothing changes: what is removed can part what composes
            old = text
            text = _IGNORED.sub("", text)
            if _KEPT.search(text):
                at, out = 0, []
                for m in _KEPT.finditer(text):
                    out += [unicodedata.normalize("NFKC", text[at : m.start()]), m.group()]
                    at = m.end()
                text = unicodedata.normalize("NFC", "".join(out) + unicodedata.normalize("NFKC", text[at:]))
            else:
                text = unicodedata.normalize("NFKC", text)
            text = _TOKEN.sub(_latin, text)
            if marks:
                text = _MARK.sub(lambda m: MARKS[m.group()], text)
            text = _SPACE.sub(" ", text)
            if trim:
                text = text.strip(" ")
            if text == old:
                break
    if fold:
        folded = text.casefold()
        text = text.casefold() if folded == text else unify(folded, False, marks, trim)
    return text


def unify_column(df: DataFrame, id_column: str, text_column: str, fold: bool = True) -> DataFrame:
    """The id and ``unified`` of every row; each distinct text of a batch is mapped once."""

    def make() -> Callable[..., dict]:
        def step(ids: list, texts: list) -> dict:
            forms = {t: unify(t, fold) for t in set(texts)}
            return {id_column: ids, "unified": [forms[t] for t in texts]}

        return step

    return map_columns(df.select(id_column, text_column), make, f"{id_column} {df.schema[id_column].dataType.simpleString()}, unified string")


def line_forms(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """One row a line: ``seen`` (hash of how it looks), ``raw`` (hash of its characters), ``altered`` (they differ) and the id.

    Lines with nothing to see give no row, and a line that stands twice in a
    text gives one. Letters decide how a line looks, and spaces of any width are
    one space each; a space more, and hyphens and quotes of other kinds, are not
    taken for the same. The hash of the look has 128 bits, as lines of all texts
    meet by it.
    """

    def make() -> Callable[..., dict]:
        forms: dict[str, tuple[bytes, int, bool] | None] = {}

        def form(line: str) -> tuple[bytes, int, bool] | None:
            seen = unify(line, marks=False, trim=False)
            if not seen.strip(" "):
                return None
            return xxhash.xxh3_128_digest(seen.encode("utf-8", "replace")), xxhash.xxh3_64_intdigest(line.encode("utf-8", "replace")) - (1 << 63), seen != line

        def step(ids: list, texts: list) -> dict:
            if len(forms) > 500_000:
                forms.clear()
            seen, raw, altered, of = [], [], [], []
            for i, t in zip(ids, texts):
                if not t:
                    continue
                for line in set(t.split("\n")):
                    if line not in forms:
                        forms[line] = form(line)
                    if (f := forms[line]) is not None:
                        seen.append(f[0])
                        raw.append(f[1])
                        altered.append(f[2])
                        of.append(i)
            return {"seen": pa.array(seen, pa.binary()), "raw": raw, "altered": altered, "record_id": of}

        return step

    kind = df.schema[id_column].dataType.simpleString()
    return map_columns(df.select(id_column, text_column), make, f"seen binary, raw bigint, altered boolean, record_id {kind}")


def lookalike_pairs(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Pairs of rows with a line that looks the same but has other characters.

    Gives ``id_a`` < ``id_b`` once for each pair. Null and blank texts, and blank
    lines, are in no pair. The lines are hashed once and kept in the shared
    folder. Of the spellings of a look one at most is the look itself, so only
    looks of an altered line can have several: lines of all others are let go.
    Then spellings are paired, a row each, and the rows of each spelling attached
    in portions of ``PORTION``, so that no task gets all rows of a usual line; the
    rows that meet are the pairs that come out.
    """
    lines = materialise(line_forms(df, id_column, text_column))
    looks = lines.where("altered").select("seen").distinct()
    several = materialise(lines.join(looks, "seen", "left_semi").select("seen", "raw", "record_id").distinct())
    spellings = several.groupBy("seen", "raw").agg(F.ceil(F.count("*") / PORTION).cast("int").alias("portions"))
    a, b = (spellings.select("seen", F.col("raw").alias(f"raw_{x}"), F.col("portions").alias(f"portions_{x}")) for x in "ab")
    paired = materialise(a.join(b, "seen").where("raw_a < raw_b"))
    sides = {}
    for x in "ab":
        whole = paired.select("seen", F.col(f"raw_{x}").alias("raw"), F.col(f"portions_{x}").alias("portions")).distinct()
        rows = several.join(whole, ["seen", "raw"]).withColumn("portion", F.pmod(F.xxhash64("record_id"), "portions").cast("int"))
        sides[x] = rows.select("seen", F.col("raw").alias(f"raw_{x}"), F.col("portion").alias(f"portion_{x}"), F.col("record_id").alias(f"of_{x}"))
    spread = paired
    for x in "ab":
        portions = F.explode(F.sequence(F.lit(0), F.col(f"portions_{x}") - 1)).alias(f"portion_{x}")
        spread = spread.select(*spread.columns, portions)
    met = spread.join(sides["a"], ["seen", "raw_a", "portion_a"]).join(sides["b"], ["seen", "raw_b", "portion_b"])
    ends = F.least("of_a", "of_b").alias("id_a"), F.greatest("of_a", "of_b").alias("id_b")
    return met.where("of_a <> of_b").select(*ends).distinct()
