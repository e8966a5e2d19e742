"""Nearest-neighbour thermodynamics."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

KELVIN, GAS = 273.15, 1.987
# Nearest-neighbour enthalpies (-0.1 kcal/mol) and entropies (-0.1 cal/(mol K)) of dinucleotides.
ENTHALPY = {"AA": 79, "AC": 84, "AG": 78, "AT": 72, "CA": 85, "CC": 80, "CG": 106, "CT": 78, "GA": 82, "GC": 98, "GG": 80, "GT": 84, "TA": 72, "TC": 82, "TG": 85, "TT": 79}
ENTROPY = {"AA": 222, "AC": 224, "AG": 210, "AT": 204, "CA": 227, "CC": 199, "CG": 272, "CT": 210, "GA": 222, "GC": 244, "GG": 199, "GT": 224, "TA": 213, "TC": 222, "TG": 227, "TT": 222}


def c_to_k(c: Column) -> Column:
    return c + F.lit(KELVIN)


def k_to_c(k: Column) -> Column:
    return k - F.lit(KELVIN)


def association(dg: Column, celsius: Column) -> Column:
    return F.exp(-dg / (F.lit(GAS) * c_to_k(celsius)))


def free_energy(ds: Column, dh: Column, celsius: Column) -> Column:
    return dh - ds * c_to_k(celsius)


def random_coil(dg: Column, celsius: Column) -> Column:
    return 1 / (association(dg, celsius) + 1)


def divalent_to_monovalent(divalent: Column, dntp: Column) -> Column:
    """Equivalent of a divalent salt; null where a concentration is negative."""
    return F.when((divalent < 0) | (dntp < 0), None).when((divalent == 0) | (divalent < dntp), 0.0).otherwise(120 * F.sqrt(divalent - dntp))


_LETTER = np.full(256, 4, np.int64)
_LETTER[[ord(x) for x in "ACGT"]] = range(4)
_HEAT, _DISORDER = (np.array([table[a + b] for a in "ACGT" for b in "ACGT"]) for table in (ENTHALPY, ENTROPY))


def thermo_of(seqs: list[str | None], conc_nm: float, salt: float) -> tuple[np.ndarray, ...]:
    """``dh, ds, tm`` of many sequences at once, from running sums over the letters of all; NaN where there is none."""
    n = np.array([0 if s is None else len(s) for s in seqs], np.int64)
    code = _LETTER[np.frombuffer("".join(s or "" for s in seqs).encode("latin-1", "replace"), np.uint8)]
    end = np.cumsum(n)
    begin = end - n
    total = lambda x: np.concatenate(([0], np.cumsum(x)))
    base = np.minimum(code, 3)
    pair = base[:-1] * 4 + base[1:]
    good = (n > 1) & (total(code > 3)[end] == total(code > 3)[begin])
    a, z = begin[good], end[good]
    heat, disorder = (total(t[pair])[z - 1] - total(t[pair])[a] for t in (_HEAT, _DISORDER))
    weak = (code == 0) | (code == 3)
    ends = weak[a].astype(np.int64) + weak[z - 1]
    odd = total(np.concatenate([base[b:e] + base[b:e][::-1] != 3 for b, e in zip(a.tolist(), z.tolist())] or [np.zeros(0, bool)]))
    upto = np.cumsum(z - a)
    same = odd[upto] == odd[upto - (z - a)]
    out = [np.full(len(seqs), np.nan) for _ in range(3)]
    dh = -100.0 * (heat - 23 * ends - (2 - ends))
    ds = -0.1 * (disorder - 41 * ends + 28 * (2 - ends) + 14 * same) + 0.368 * (z - a - 1) * np.log(salt / 1000.0)
    for x, v in zip(out, (dh, ds, dh / (ds + GAS * np.log(conc_nm / np.where(same, 1e9, 4e9))) - KELVIN)):
        x[good] = v
    return tuple(out)


def thermo(seq: Column, conc_nm: float = 50, monovalent: float = 50, divalent: float = 0.01, dntp: float = 0.0, corrected: bool = False) -> Column:
    """``dh, ds, tm`` of an upper-case A, C, G, T sequence; null for others and for fewer than two bases.

    ``corrected`` takes the divalent salt into account in the salt term.
    """
    salt = monovalent + (120 * (divalent - dntp) ** 0.5 if corrected and divalent > dntp else 0)

    @F.pandas_udf("dh double, ds double, tm double")
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(("dh", "ds", "tm"), thermo_of(s.tolist(), conc_nm, salt))))

    t = run(seq)
    return F.when(seq.rlike("^[ACGT]{2,}$"), t)


def melting_temperature(seq: Column, **conditions: float) -> Column:
    return thermo(seq, **conditions)["tm"]


def tm_of(seq: str) -> float:
    """The melting temperature of a short A, C, G, T string under the default conditions, in Python."""
    symmetric = seq == seq.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    ends = (seq[0] in "AT") + (seq[-1] in "AT")
    pairs = [seq[i : i + 2] for i in range(len(seq) - 1)]
    dh = -100.0 * (sum(ENTHALPY[p] for p in pairs) - 23 * ends - (2 - ends))
    ds = -0.1 * (sum(ENTROPY[p] for p in pairs) - 41 * ends + 28 * (2 - ends) + 14 * symmetric) + 0.368 * (len(seq) - 1) * math.log(0.05)
    return dh / (ds + GAS * math.log(50 / (1e9 if symmetric else 4e9))) - KELVIN


def dimer_tm(a: str, b: str) -> float:
    """Of the ends of ``a`` (4 to 8 bases) that ``b`` can pair with, the highest melting temperature; 0 where there is none."""
    other = b.translate(str.maketrans("ACGTacgt", "TGCATGCA"))[::-1]
    best = 0.0
    for n in (4, 5, 6, 7, 8):
        tail = a[-n:]
        if len(tail) < n or tail not in other:
            break
        if not set(tail) - set("ACGT"):
            best = max(best, tm_of(tail))
    return best


@F.pandas_udf(DoubleType())
def _dimers(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else dimer_tm(x, y) for x, y in zip(a, b)], dtype="Float64")


def heterodimer_proxy(a: Column, b: Column) -> Column:
    """A stand-in for the heterodimer temperature of an alignment library: ``dimer_tm`` of the two strands."""
    return _dimers(a, b)
