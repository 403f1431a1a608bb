"""Column functions on sequences, coordinates and names.

Intervals in this library have lo and hi, 0-based and half-open, and a strand "+" or "-".
Functions that take closed 1-based positions say so.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def revcomp(seq: ColumnOrName) -> Column:
    """Reverse complement; case and N stay."""
    return F.reverse(F.translate(_c(seq), "ACGTacgtNn", "TGCAtgcaNn"))


def mask_iupac(seq: ColumnOrName, upper: bool = True) -> Column:
    """Everything but A, C, G and T becomes N; lower case counts as upper unless upper=False."""
    return F.regexp_replace(F.upper(_c(seq)) if upper else _c(seq), "[^ATCG]", "N")


def count_n(seq: ColumnOrName) -> Column:
    return F.length(_c(seq)) - F.length(F.translate(_c(seq), "Nn", ""))


def repeat_ratio(masked: ColumnOrName, unmasked: ColumnOrName) -> Column:
    """Percentage of bases that only the masked text hides; null for empty sequences."""
    return F.when(F.length(_c(unmasked)) > 0, 100.0 * (count_n(masked) - count_n(unmasked)) / F.length(_c(unmasked)))


def gff_attribute(attributes: ColumnOrName, prefix: str) -> Column:
    """What follows the prefix in the first `;`-separated field that begins with it, else null."""
    fields = F.transform(F.split(_c(attributes), ";"), lambda f: F.trim(f))
    found = F.filter(fields, lambda f: f.startswith(prefix))
    return F.try_element_at(F.transform(found, lambda f: f.substr(F.lit(len(prefix) + 1), F.length(f))), F.lit(1))


def gene_from_description(description: ColumnOrName) -> Column:
    """The token after `gene:`, else "unknown"."""
    found = F.regexp_extract(_c(description), r"gene:(\S+)", 1)
    return F.when(found != "", found).otherwise(F.lit("unknown"))


def expand(lo: ColumnOrName, hi: ColumnOrName, strand: ColumnOrName, up: int, down: int) -> tuple[Column, Column]:
    """Bounds grown by `up` bases at the 5' end and `down` at the 3' end, not clipped."""
    plus = _c(strand) == "+"
    return _c(lo) - F.when(plus, F.lit(up)).otherwise(F.lit(down)), _c(hi) + F.when(plus, F.lit(down)).otherwise(F.lit(up))


def interval_length(five: ColumnOrName, three: ColumnOrName) -> Column:
    """Of a closed interval given by its ends in either order."""
    return F.abs(_c(five) - _c(three)) + 1


def working_sequence(kind: ColumnOrName, reference: ColumnOrName, masked: ColumnOrName, modified: ColumnOrName) -> Column:
    """The text that `kind` names (reference, masked, modified); null for other names."""
    return F.when(_c(kind) == "reference", _c(reference)).when(_c(kind) == "masked", _c(masked)).when(_c(kind) == "modified", _c(modified))


def windows(seq: ColumnOrName, width: int, step: int = 1) -> Column:
    """All (offset, seq) windows that lie wholly inside, as an array."""
    last = F.length(_c(seq)) - width
    starts = F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(step))).otherwise(F.array().cast("array<int>"))
    # Bases are bytes: a slice of bytes costs its own width, one of a string all that is before it.
    cut = lambda whole: F.transform(starts, lambda i: F.struct(i.alias("offset"), whole.substr(i + 1, F.lit(width)).cast("string").alias("seq")))
    return F.get(F.transform(F.array(_c(seq).cast("binary")), cut), 0)


def site_interval(position: ColumnOrName, width: int | Column, site_strand: ColumnOrName, lo: ColumnOrName, hi: ColumnOrName, strand: ColumnOrName) -> tuple[Column, Column, Column]:
    """lo, hi and strand on the region of a site of a sequence that was cut from [lo, hi) and turned to its strand."""
    forward = _c(strand) == "+"
    start = F.when(forward, _c(lo) + _c(position)).otherwise(_c(hi) - _c(position) - width)
    same = _c(site_strand) == _c(strand)
    return start, start + width, F.when(same, F.lit("+")).otherwise(F.lit("-"))


def bundle_interval(start: ColumnOrName, end: ColumnOrName, lo: ColumnOrName, hi: ColumnOrName, strand: ColumnOrName) -> tuple[Column, Column]:
    """Bounds on the region of the closed stretch [start, end] of a sequence that was cut from [lo, hi)."""
    forward = _c(strand) == "+"
    return F.when(forward, _c(lo) + _c(start)).otherwise(_c(hi) - _c(end) - 1), F.when(forward, _c(lo) + _c(end) + 1).otherwise(_c(hi) - _c(start))


def distance_to_locus(lo: ColumnOrName, hi: ColumnOrName, position: ColumnOrName, strand: ColumnOrName) -> Column:
    """From the 3' end of [lo, hi) to a locus; negative where the interval passes it."""
    return F.when(_c(strand) == "+", _c(position) - _c(hi)).otherwise(_c(lo) - _c(position) - 1)


def relative_location(lo: ColumnOrName, hi: ColumnOrName, strand: ColumnOrName, anchor: str, offset: int, length: int, size: ColumnOrName) -> tuple[Column, Column]:
    """`length` bases from `offset` behind a gene's 5' or 3' end (before it if negative), in reading
    direction, cut at the sequence's bounds."""
    if anchor not in ("5", "3"):
        raise ValueError("anchor: 5 or 3")
    forward = _c(strand) == "+"
    begin = _c(lo) if anchor == "5" else _c(hi)
    begin_back = _c(hi) if anchor == "5" else _c(lo)
    a = F.when(forward, begin + offset).otherwise(begin_back - offset - length)
    return F.least(F.greatest(a, F.lit(0)), _c(size)), F.least(F.greatest(a + length, F.lit(0)), _c(size))


def shuffle_sequence(seq: ColumnOrName, seed: int) -> Column:
    """The upper-cased letters in an order that the seed fixes."""
    letters = F.transform(F.split(F.upper(_c(seq)), ""), lambda c, i: F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), i.cast("string"))).alias("k"), c.alias("c")))
    return F.array_join(F.transform(F.array_sort(letters), lambda x: x["c"]), "")


def neg_log10_p(p: ColumnOrName) -> Column:
    """-log10(p), 20 for 0; null outside [0, 1]."""
    return F.when(_c(p) == 0, F.lit(20.0)).when((_c(p) > 0) & (_c(p) <= 1), -F.log10(_c(p)))


def sampling_likelihood(p: ColumnOrName, floor: float) -> Column:
    return F.greatest(2 * (1 / (1 + _c(p)) - 0.5), F.lit(floor))


def safe_name(name: ColumnOrName) -> Column:
    """Colons, commas, slashes, angle brackets and pipes become dashes, spaces underscores."""
    return F.translate(_c(name), ":,/\\<>| ", "-------_")


def go_terms(note: ColumnOrName) -> Column:
    """(kind, term) of the `;`-separated parts that begin with GO_process or GO_component."""
    parts = F.transform(F.split(_c(note), ";"), lambda p: F.trim(p))
    kept = F.filter(parts, lambda p: p.startswith("GO_process") | p.startswith("GO_component"))
    return F.transform(kept, lambda p: F.struct(F.substring_index(p, ":", 1).alias("kind"), F.trim(F.regexp_replace(p, "^GO_(process|component):?", "")).alias("term")))


def belief(percent: ColumnOrName, repeats: ColumnOrName, low: ColumnOrName | int, high: ColumnOrName | int) -> tuple[Column, Column]:
    """(belief, integrated score) of a window pair.

    Both percentages count as whole numbers.  The score above the repeats, stretched by at most
    1.5 for what repeats hide and cut at 100, gives belief 0 up to low, 1 from high on, and a
    logistic rise between.
    """
    s, r = F.floor(_c(percent)), F.floor(_c(repeats))
    low, high = (F.lit(x) if isinstance(x, int) else _c(x) for x in (low, high))
    stretch = F.when(r < 100, F.least(F.lit(1.5), 100.0 / F.greatest(100 - r, F.lit(1)))).otherwise(F.lit(1.5))
    score = F.when(s >= r, F.least(F.lit(100.0), stretch * (s - r))).otherwise(F.lit(0.0))
    rise = 1 / (1 + F.exp(5 - 10 * (score - low) / (high - low)))
    return F.when(score <= low, F.lit(0.0)).when(score >= high, F.lit(1.0)).otherwise(rise), score
