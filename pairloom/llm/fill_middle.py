"""Operator 13: fill-in-the-middle examples, cut by bit-parallel big integers.

A text's bytes become a big integer with one bit a byte: ``bytes.translate``
turns them into the digits of a class mask (continuation bytes, blanks, line
feeds), and shifts with boolean operations turn classes into the places where a
unit ends.  ``bit_count`` is the number of units, and the byte where the k-th
ends is found by halving the integer: the lower half's count tells which half
holds it.  So no list of units or offsets is made, and a text of n bytes costs
a few passes over n / 8 bytes.

Every row is a task's own business: nothing is shuffled, sorted or collected.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm._shared import prepare

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Of 100 texts so many are transformed; of 100 of those so many have the suffix first.
RATE, SUFFIX_FIRST = 90, 20
UNITS = ("characters", "words", "lines")


def _digits(ones: bytes) -> bytes:
    """A table for ``translate``: the digit 1 for the bytes of a class, 0 for all others."""
    return bytes(0x31 if b in ones else 0x30 for b in range(256))


_CONTINUES = _digits(bytes(range(0x80, 0xC0)))
_BLANK = _digits(b" \t\n\v\f\r")
_FEED = _digits(b"\n")


def class_mask(data: bytes, digits: bytes) -> int:
    """Bit i is one where byte i is of the class."""
    return int(data[::-1].translate(digits), 2) if data else 0


def unit_ends(data: bytes, units: str = "characters") -> int:
    """Bit i is one where a unit's last byte is byte i.

    ``characters`` are code points.  A word takes the blanks behind it, and
    blanks before the first word are a unit of their own; a line takes its line
    feed.  Units cover the text: the last byte ends one.
    """
    if units not in UNITS:
        raise ValueError(f"units are {', '.join(UNITS)}")
    if not data:
        return 0
    last = 1 << (len(data) - 1)
    whole = (last << 1) - 1
    if units == "characters":
        return whole & ~(class_mask(data, _CONTINUES) >> 1)
    if units == "lines":
        return class_mask(data, _FEED) | last
    blank = class_mask(data, _BLANK)
    return (blank & ~(blank >> 1)) | last


def ranked_bit(mask: int, rank: int) -> int:
    """The place of the one bit that has ``rank`` one bits below it."""
    if not 0 <= rank < mask.bit_count():
        raise IndexError("no bit of that rank")
    at, width = 0, mask.bit_length()
    while width > 1:
        half = width // 2
        low = mask & ((1 << half) - 1)
        below = low.bit_count()
        if rank < below:
            mask, width = low, half
        else:
            mask, width, rank, at = mask >> half, width - half, rank - below, at + half
    return at


def draws(doc_id: int | None, seed: int = 1) -> list[int]:
    """h1 to h4 of a document; a null id counts as an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]


def cut(data: bytes, first: int, second: int, units: str = "characters") -> tuple[int, int, int, tuple[bytes, bytes, bytes]]:
    """(units in all, in the prefix, in the middle, (prefix, middle, suffix)); the cuts are ``first`` and ``second`` modulo n + 1."""
    ends = unit_ends(data, units)
    n = ends.bit_count()
    a, b = sorted((first % (n + 1), second % (n + 1)))
    at = [0 if k == 0 else ranked_bit(ends, k - 1) + 1 for k in (a, b)]
    return n, a, b - a, (data[: at[0]], data[at[0] : at[1]], data[at[1] :])


def transform_text(doc_id: int | None, data: bytes, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, units: str = "characters", seed: int = 1):
    """(n, form, units of the prefix, of the middle, output); the two are None where the form is plain."""
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not data or h3 % 100 >= rate or any(s in data for s in (PREFIX, SUFFIX, MIDDLE)):
        return unit_ends(data, units).bit_count(), "plain", None, None, data
    n, before, inside, (prefix, middle, suffix) = cut(data, h1, h2, units)
    if h4 % 100 < suffix_first:
        return n, "spm", before, inside, b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return n, "psm", before, inside, b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def restore_text(output: bytes, form: str) -> bytes:
    """The text that ``output`` was made from.

    A text that has a marker stays plain, and no marker begins as another ends,
    so the first of each kind is the one that was put there.
    """
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    if form not in ("psm", "spm") or not output.startswith(first):
        raise ValueError(f"not an output of form {form}")
    a, rest = output[len(first) :].split(second, 1)
    b, middle = rest.split(MIDDLE, 1)
    prefix, suffix = (a, b) if form == "psm" else (b, a)
    return prefix + middle + suffix


def fill_in_middle(docs: DataFrame, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, units: str = "characters", seed: int = 1, digest: bool = False) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output for every row of ``docs`` (doc_id, text).

    With ``digest`` there are output_sha256 and restored_sha256, of the output
    and of the text rebuilt from it, instead of the output itself.  A null text
    is empty, and an empty one stays plain; a null id draws as an empty one;
    rows of one id are cut by the same draws, repeated rows alike; an empty
    table gives no rows; other columns are not read, whatever their names.  A
    text of any length is cut whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b["doc_id"]
            made = [transform_text(i.as_py(), t.as_py(), rate, suffix_first, units, seed) for i, t in zip(ids, b["text"], strict=True)]
            n, form, before, inside, out = zip(*made, strict=True) if made else ((), (), (), (), ())
            longs = [pa.array(x, pa.int64()) for x in (n, before, inside)]
            if digest:
                back = [hashlib.sha256(restore_text(o, f)).hexdigest() for o, f in zip(out, form, strict=True)]
                last = [pa.array([hashlib.sha256(o).hexdigest() for o in out], pa.string()), pa.array(back, pa.string())]
            else:
                last = [pa.array(out, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([ids, longs[0], pa.array(form, pa.string()), *longs[1:], *last], names)

    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", *(["output_sha256", "restored_sha256"] if digest else ["output"])]
    kinds = ["long", "long", "string", "long", "long", *["string"] * (len(names) - 5)]
    prepare(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    return rows.mapInArrow(run, ", ".join(f"{a} {k}" for a, k in zip(names, kinds, strict=True)))


def restore(examples: DataFrame) -> DataFrame:
    """``examples`` (form, output and any others) with the rebuilt text as column ``text``: SQL functions only; a null output has none."""
    marks = {"psm": (PREFIX, SUFFIX, "$1$3$2"), "spm": (SUFFIX, PREFIX, "$2$3$1")}
    text = F.col("output")
    for form, (first, second, order) in marks.items():
        parts = rf"(?s)\A{first.decode()}(.*?){second.decode()}(.*?){MIDDLE.decode()}(.*)\z"
        text = F.when(F.col("form") == form, F.regexp_replace("output", parts, order)).otherwise(text)
    return examples.withColumn("text", text)


def oracle() -> str:
    """SQL of the query: code points by substr; the rebuilt text is the text itself."""
    h = lambda k: f"('0x' || substr(d, {8 * k + 1}, 8))::BIGINT"
    return f"""WITH t AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
h AS (SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, {h(0)} AS h1, {h(1)} AS h2, {h(2)} AS h3, {h(3)} AS h4 FROM t),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
 CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= {RATE} THEN 'plain' WHEN h4 % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1) AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""
