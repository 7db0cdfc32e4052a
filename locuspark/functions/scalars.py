"""Column functions: identifiers, transforms and rule labels. All of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

LFC_MIN, PADJ_MAX = 0.5, 0.05
TIMES = (12, 30, 60)


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def flag(condition: Column) -> Column:
    """A condition that is false where it is unknown."""
    return F.coalesce(condition, F.lit(False))


def number_or_null(text: Column | str) -> Column:
    """A double; empty, NA and NaN become null."""
    x = F.trim(_c(text).cast("string"))
    return F.when(~F.upper(x).isin("", "NA", "NAN", "NULL"), x.try_cast("double"))


def strip_version(col: Column | str, mode: str = "number") -> Column:
    """An id without its version: ``number`` a trailing .digits, ``first`` all after the first dot, ``last`` the last .part."""
    c = _c(col)
    if mode == "first":
        return F.substring_index(c, ".", 1)
    return F.regexp_replace(c, {"number": r"\.\d+$", "last": r"\.[^.]+$"}[mode], "")


def locus_id(chrom: Column | str, start: Column | str, end: Column | str, name: Column | str) -> Column:
    return F.concat(_c(chrom), F.lit(":"), _c(start).cast("string"), F.lit("-"), _c(end).cast("string"), F.lit(":"), _c(name).cast("string"))


def log2p1(x: Column | str) -> Column:
    return F.log2(_c(x) + 1)


def neg_log10(p: Column | str) -> Column:
    return F.when(_c(p).isNotNull(), -F.log10(F.greatest(_c(p), F.lit(1e-300))))


def rpkm(count: Column | str, length: Column | str, total: Column | str) -> Column:
    """Reads per kilobase and million; null where length or total is 0."""
    return _c(count) * F.lit(1e9) / F.nullif(_c(length).cast("double") * _c(total), F.lit(0.0))


def log2_ratio(real: Column | str, simulated: Column | str, pseudo: float = 1e-3) -> Column:
    """log2 of real over simulated; without a simulation, of real alone."""
    top = F.log2(_c(real) + pseudo)
    return F.when(_c(simulated).isNull(), top).otherwise(top - F.log2(_c(simulated) + pseudo))


def tss(start: Column | str, end: Column | str, strand: Column | str) -> Column:
    """0-based start site of a feature with 1-based, inclusive coordinates."""
    return F.when(_c(strand) == "+", _c(start) - 1).otherwise(_c(end) - 1)


def max_of(*cols: Column | str) -> Column:
    """Largest of several columns; nulls and NaN are passed over."""
    clean = [F.nanvl(_c(c).cast("double"), F.lit(None).cast("double")) for c in cols]
    return F.greatest(*clean) if len(clean) > 1 else clean[0]


def assign_group(first: Column, second: Column, names: Sequence[str] = ("hit", "control", "none")) -> Column:
    """The first group that holds, by precedence."""
    return F.when(flag(first), names[0]).when(flag(second), names[1]).otherwise(names[2])


def strand_of_file(path: Column | str) -> Column:
    """+ for a file of minus-strand data, - for the other: such files hold the opposite strand."""
    return F.when(_c(path).contains("minus"), "+").otherwise("-")


def direction(lfc: Column | str, padj: Column | str) -> Column:
    """repressed for a significant positive change (the contrast is start over later), induced for a negative one."""
    sure = _c(padj) < PADJ_MAX
    return F.when(sure & (_c(lfc) > LFC_MIN), "repressed").when(sure & (_c(lfc) < -LFC_MIN), "induced").otherwise("not_sig")


def trajectory(dirs: Sequence[Column | str], lrt_padj: Column | str) -> Column:
    """Course over the time points in ``dirs``, the last of which tells sustained from transient."""
    every = F.array(*map(_c, dirs))
    down, up = F.array_contains(every, "repressed"), F.array_contains(every, "induced")
    last = _c(dirs[-1])
    return (
        F.when(down & up, "complex")
        .when(down, F.when(last == "repressed", "repressed_sustained").otherwise("repressed_transient"))
        .when(up, F.when(last == "induced", "induced_sustained").otherwise("induced_transient"))
        .when(flag(_c(lrt_padj) < PADJ_MAX), "lrt_only")
        .otherwise("not_responsive")
    )


def response_label(lrt_padj: Column | str, dirs: Sequence[Column | str]) -> Column:
    """Label of an entity's response: needs the overall test first, then its contrasts."""
    found = F.array_distinct(F.filter(F.array(*map(_c, dirs)), lambda d: d != "not_sig"))
    end = F.when(_c(dirs[-1]) != "not_sig", "_sustained").otherwise("_transient")
    return (
        F.when(~flag(_c(lrt_padj) < PADJ_MAX), "not_sig")
        .when(F.size(found) == 0, "sig_lrt_no_pairwise")
        .when(F.size(found) > 1, "ambiguous")
        .otherwise(F.concat(found[0], end))
    )


def first_hit(dirs: Sequence[Column | str], labels: Sequence[object]) -> Column:
    """Label of the first direction that is not not_sig, or NA; give both in reverse for the last."""
    return F.coalesce(*(F.when(_c(d) != "not_sig", F.lit(str(n))) for d, n in zip(dirs, labels, strict=True)), F.lit("NA"))


def stars(p: Column | str, three: bool = True) -> Column:
    out = F.when(_c(p) < 0.001, "***") if three else F.when(_c(p) < 0.01, "**")
    return (out.when(_c(p) < 0.01, "**") if three else out).when(_c(p) < 0.05, "*").otherwise("ns")


def karyotype_order(chrom: Column | str) -> Column:
    """1..22, X, Y, M as numbers; unknown contigs after them."""
    bare = F.regexp_replace(_c(chrom), "^chr", "")
    return F.coalesce(F.when(bare.rlike("^([1-9]|1[0-9]|2[0-2])$"), bare.cast("int")), F.when(bare == "X", 23), F.when(bare == "Y", 24), F.when(bare.isin("M", "MT"), 25), F.lit(99))


def preferred_order(col: Column | str, order: Sequence[str]) -> Column:
    """Sort key that puts listed values first, in the given order; others follow by name."""
    at = F.array_position(F.array(*map(F.lit, order)), _c(col))
    return F.struct(F.when(at > 0, at).otherwise(F.lit(len(order) + 1)).alias("place"), _c(col).alias("name"))
