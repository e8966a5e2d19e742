"""Sequence strings: reversal, complement, seeded random sequences, wrapping."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The IUPAC letters and their complements.
IUPAC = "ABCDGHKMNRSTUVWYabcdghkmnrstuvwy"
IUPAC_COMPLEMENT = "TVGHCDMKNYSAABWRtvghcdmknysaabwr"


def reverse(seq: Column) -> Column:
    return F.reverse(seq)


def complement(seq: Column) -> Column:
    """IUPAC complement, case kept; any other character but a line feed becomes ``?``."""
    return F.translate(F.regexp_replace(seq, f"[^{IUPAC}\n]", "?"), IUPAC, IUPAC_COMPLEMENT)


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def simple_complement(seq: Column) -> Column:
    """Complement of A, C, G, T in upper case; other characters stay."""
    return F.translate(seq, "ACGTacgt", "TGCATGCA")


def simple_reverse_complement(seq: Column) -> Column:
    return F.reverse(simple_complement(seq))


def _uniform(seed: int, key: Column, i: Column) -> Column:
    """A number in [0, 1) that depends on the seed, the row's key and the place only."""
    return F.pmod(F.xxhash64(F.lit(seed), key, i), F.lit(1 << 30)) / F.lit(float(1 << 30))


def random_sequence(key: Column, n: int, seed: int = 0, probs: dict[str, float] | None = None) -> Column:
    """``n`` random bases, the same for a key and seed on every run; ``probs`` weights the bases."""
    weights = probs or dict.fromkeys("ACGT", 0.25)
    total = sum(weights.values())

    def base(i: Column) -> Column:
        u, upto, out = _uniform(seed, key, i), 0.0, None
        for b, p in list(weights.items())[:-1]:
            upto += p / total
            out = F.when(u < upto, b) if out is None else out.when(u < upto, b)
        last = F.lit(list(weights)[-1])
        return last if out is None else out.otherwise(last)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), base), "") if n else F.lit("")


def random_duplex(key: Column, n: int, seed: int = 0) -> Column:
    """Random bases and their complement."""
    fwd = random_sequence(key, n, seed)
    return F.struct(fwd.alias("fwd"), complement(fwd).alias("rev"))


def random_avoiding(key: Column, flank: Column, n: int, word: int, seed: int = 0, limit: int = 3, tries: int = 1000) -> Column:
    """Random bases that share no word with ``flank`` or its reverse complement and have no run longer than ``limit``.

    Drawn again until they fit, from a generator seeded by the key; null after ``tries`` draws.
    """

    @F.pandas_udf(StringType())
    def draw(keys: pd.Series, flanks: pd.Series) -> pd.Series:
        table = str.maketrans("ACGT", "TGCA")
        runs = [b * (limit + 1) for b in "ACGT"]

        def one(k: object, f: str | None) -> str | None:
            f = f or ""
            both = (f, f.translate(table)[::-1])
            own = {s[i : i + word] for s in both for i in range(len(s) - word + 1)}
            rng = random.Random(f"{seed}/{k}")
            for _ in range(tries):
                s = "".join(rng.choices("ACGT", k=n))
                if not any(r in s for r in runs) and not any(s[i : i + word] in own for i in range(n - word + 1)):
                    return s
            return None

        return pd.Series([one(k, f) for k, f in zip(keys, flanks)], dtype=object)

    return draw(key, flank)


def hard_wrap(text: Column, width: int) -> Column:
    """Lines of at most ``width`` characters."""
    return F.regexp_replace(F.regexp_replace(text, f"(?s)(.{{{width}}})", "$1\n"), r"\n$", "")


def is_alphabet(seq: Column, letters: str, not_allowed: str = "") -> Column:
    """Whether a sequence has letters of an alphabet only, without the disallowed ones."""
    allowed = "".join(c for c in letters if c not in not_allowed)
    return ~seq.rlike(f"[^{allowed}]")


# Alphabets of sequence files.
ALPHABETS = {"DNA": "ACGTWSMKRYBDHVN", "RNA": "ACGUWSMKRYBDHVN", "AMINO_ACID": "ABCDEFGHIJKLMNOPQRSTUVWYZX*-"}


def checked(seq: Column, alphabet: str = "DNA", not_allowed: str = "") -> Column:
    """The sequence, or an error where a character isn't in the alphabet."""
    letters = ALPHABETS.get(alphabet, alphabet)
    bad = F.concat(F.lit("character outside the alphabet in "), F.substring(seq, 1, 40))
    return F.when(is_alphabet(seq, letters, not_allowed), seq).when(seq.isNotNull(), F.raise_error(bad).cast("string"))
