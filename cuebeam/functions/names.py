"""Name similarity: optimal string alignment, Double Metaphone and the decision that joins them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: What one worker remembers of each function. Keys of a token take kilobytes, so of them it is little.
REMEMBERED, REMEMBERED_KEYS = 50_000, 5000


@lru_cache(maxsize=REMEMBERED)
def osa_distance(a: str, b: str) -> int:
    """Edits (insert, delete, replace, swap of neighbours) that turn a into b, no part edited twice."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(row[j - 1] + 1, rows[-1][j] + 1, rows[-1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, rows[-2][j - 2] + 1)
            row.append(best)
        rows = [rows[-1], row]
    return rows[-1][-1]


VOWELS = frozenset("AEIOUY")


@lru_cache(maxsize=REMEMBERED)
def double_metaphone(word: str) -> tuple[str, str]:
    """Primary and alternate code of a word, after Lawrence Philips' published rules.

    Each rule looks at the letter at i and its surroundings and gives what is appended to either
    code and how far to go.
    """
    w = "".join(c for c in word.upper() if c.isalpha() or c == "Ç")
    if not w:
        return "", ""
    n, first, second, i = len(w), [], [], 0
    slavic = any(s in w for s in ("W", "K", "CZ", "WITZ"))

    def at(k: int, *options: str) -> bool:
        return k >= 0 and any(w[k : k + len(o)] == o for o in options)

    def vowel(k: int) -> bool:
        return 0 <= k < n and w[k] in VOWELS

    germanic = at(0, "VAN ", "VON ", "SCH")

    def add(a: str, b: str | None = None) -> None:
        first.append(a)
        second.append(a if b is None else b)

    if at(0, "GN", "KN", "PN", "WR", "PS"):
        i = 1
    if at(0, "X"):
        add("S")
        i = 1
    while i < n:
        c = w[i]
        step = 2 if at(i + 1, c) else 1
        if c in VOWELS:
            if i == 0:
                add("A")
            step = 1
        elif c == "B":
            add("P")
        elif c == "Ç":
            add("S")
            step = 1
        elif c == "C":
            if i > 1 and not vowel(i - 2) and at(i - 1, "ACH") and not at(i + 2, "I") and (not at(i + 2, "E") or at(i - 2, "BACHER", "MACHER")):
                add("K")
                step = 2
            elif i == 0 and at(0, "CAESAR"):
                add("S")
                step = 2
            elif at(i, "CHIA"):
                add("K")
                step = 2
            elif at(i, "CH"):
                step = 2
                if i > 0 and at(i, "CHAE"):
                    add("K", "X")
                elif i == 0 and (at(1, "HARAC", "HARIS", "HOR", "HYM", "HIA", "HEM")) and not at(0, "CHORE"):
                    add("K")
                elif germanic or at(i - 2, "ORCHES", "ARCHIT", "ORCHID") or at(i + 2, "T", "S") or ((i == 0 or at(i - 1, "A", "O", "U", "E")) and (at(i + 2, "L", "R", "N", "M", "B", "H", "F", "V", "W") or i + 2 >= n)):
                    add("K")
                elif i > 0:
                    add("K") if at(0, "MC") else add("X", "K")
                else:
                    add("X")
            elif at(i, "CZ") and not at(i - 2, "WICZ"):
                add("S", "X")
                step = 2
            elif at(i + 1, "CIA"):
                add("X")
                step = 3
            elif at(i, "CC") and not (i == 1 and w[0] == "M"):
                if at(i + 2, "I", "E", "H") and not at(i + 2, "HU"):
                    add("KS") if (i == 1 and w[0] == "A") or at(i - 1, "UCCEE", "UCCES") else add("X")
                    step = 3
                else:
                    add("K")
                    step = 2
            elif at(i, "CK", "CG", "CQ"):
                add("K")
                step = 2
            elif at(i, "CI", "CE", "CY"):
                add("S", "X") if at(i, "CIO", "CIE", "CIA") else add("S")
                step = 2
            else:
                add("K")
                step = 2 if at(i + 1, "C", "K", "Q") and not at(i + 1, "CE", "CI") else 1
        elif c == "D":
            if at(i, "DG"):
                if at(i + 2, "I", "E", "Y"):
                    add("J")
                    step = 3
                else:
                    add("TK")
                    step = 2
            else:
                add("T")
                step = 2 if at(i, "DT", "DD") else 1
        elif c == "F":
            add("F")
        elif c == "G":
            if at(i + 1, "H"):
                step = 2
                if i > 0 and not vowel(i - 1):
                    add("K")
                elif i == 0:
                    add("J") if at(2, "I") else add("K")
                elif not ((i > 1 and at(i - 2, "B", "H", "D")) or (i > 2 and at(i - 3, "B", "H", "D")) or (i > 3 and at(i - 4, "B", "H"))):
                    if i > 2 and w[i - 1] == "U" and at(i - 3, "C", "G", "L", "R", "T"):
                        add("F")
                    elif i > 0 and w[i - 1] != "I":
                        add("K")
            elif at(i + 1, "N"):
                step = 2
                if i == 1 and vowel(0) and not slavic:
                    add("KN", "N")
                elif not at(i + 2, "EY") and not slavic:
                    add("N", "KN")
                else:
                    add("KN")
            elif at(i + 1, "LI") and not slavic:
                add("KL", "L")
                step = 2
            elif i == 0 and (at(1, "Y") or at(1, "ES", "EP", "EB", "EL", "EY", "IB", "IL", "IN", "IE", "EI", "ER")):
                add("K", "J")
                step = 2
            elif (at(i + 1, "ER") or at(i + 1, "Y")) and not at(0, "DANGER", "RANGER", "MANGER") and not at(i - 1, "E", "I") and not at(i - 1, "RGY", "OGY"):
                add("K", "J")
                step = 2
            elif at(i + 1, "E", "I", "Y") or at(i - 1, "AGGI", "OGGI"):
                if germanic or at(i + 1, "ET"):
                    add("K")
                else:
                    add("J") if at(i + 1, "IER") else add("J", "K")
                step = 2
            else:
                add("K")
        elif c == "H":
            if (i == 0 or vowel(i - 1)) and vowel(i + 1):
                add("H")
                step = 2
            else:
                step = 1
        elif c == "J":
            if at(i, "JOSE") or at(0, "SAN"):
                add("H") if (i == 0 and n == 4) or at(0, "SAN") else add("J", "H")
            elif i == 0:
                add("J", "A")
            elif vowel(i - 1) and not slavic and at(i + 1, "A", "O"):
                add("J", "H")
            elif i == n - 1:
                add("J", "")
            elif not at(i + 1, "L", "T", "K", "S", "N", "M", "B", "Z") and not at(i - 1, "S", "K", "L"):
                add("J")
        elif c == "K":
            add("K")
        elif c == "L":
            if at(i + 1, "L") and ((i == n - 3 and at(i - 1, "ILLO", "ILLA", "ALLE")) or ((at(n - 2, "AS", "OS") or at(n - 1, "A", "O")) and at(i - 1, "ALLE"))):
                add("L", "")
            else:
                add("L")
        elif c == "M":
            add("M")
            step = 2 if (at(i - 1, "UMB") and (i + 1 == n - 1 or at(i + 2, "ER"))) or at(i + 1, "M") else 1
        elif c in "NÑ":
            add("N")
        elif c == "P":
            if at(i + 1, "H"):
                add("F")
                step = 2
            else:
                add("P")
                step = 2 if at(i + 1, "P", "B") else 1
        elif c == "Q":
            add("K")
        elif c == "R":
            if i == n - 1 and not slavic and at(i - 2, "IE") and not at(i - 4, "ME", "MA"):
                add("", "R")
            else:
                add("R")
        elif c == "S":
            if at(i - 1, "ISL", "YSL"):
                step = 1
            elif i == 0 and at(0, "SUGAR"):
                add("X", "S")
                step = 1
            elif at(i, "SH"):
                add("S") if at(i + 1, "HEIM", "HOEK", "HOLM", "HOLZ") else add("X")
                step = 2
            elif at(i, "SIO", "SIA"):
                add("S") if slavic else add("S", "X")
                step = 3
            elif (i == 0 and at(1, "M", "N", "L", "W")) or at(i + 1, "Z"):
                add("S", "X")
                step = 2 if at(i + 1, "Z") else 1
            elif at(i, "SC"):
                step = 3
                if at(i + 2, "H"):
                    if at(i + 3, "OO", "ER", "EN", "UY", "ED", "EM"):
                        add("X", "SK") if at(i + 3, "ER", "EN") else add("SK")
                    elif i == 0 and not vowel(3) and not at(3, "W"):
                        add("X", "S")
                    else:
                        add("X")
                elif at(i + 2, "I", "E", "Y"):
                    add("S")
                else:
                    add("SK")
            else:
                if i == n - 1 and at(i - 2, "AI", "OI"):
                    add("", "S")
                else:
                    add("S")
                step = 2 if at(i + 1, "S", "Z") else 1
        elif c == "T":
            if at(i, "TION", "TIA", "TCH"):
                add("X")
                step = 3
            elif at(i, "TH", "TTH"):
                add("T") if at(i + 2, "OM", "AM") or germanic else add("0", "T")
                step = 2
            else:
                add("T")
                step = 2 if at(i + 1, "T", "D") else 1
        elif c == "V":
            add("F")
        elif c == "W":
            step = 1
            if at(i, "WR"):
                add("R")
                step = 2
            elif i == 0 and (vowel(1) or at(0, "WH")):
                add("A", "F") if vowel(1) else add("A")
            elif (i == n - 1 and vowel(i - 1)) or at(i - 1, "EWSKI", "EWSKY", "OWSKI", "OWSKY") or at(0, "SCH"):
                add("", "F")
            elif at(i, "WICZ", "WITZ"):
                add("TS", "FX")
                step = 4
        elif c == "X":
            if not (i == n - 1 and (at(i - 3, "IAU", "EAU") or at(i - 2, "AU", "OU"))):
                add("KS")
            step = 2 if at(i + 1, "C", "X") else 1
        elif c == "Z":
            if at(i + 1, "H"):
                add("J")
                step = 2
            else:
                add("S", "TS") if at(i + 1, "ZO", "ZI", "ZA") or (slavic and i > 0 and w[i - 1] != "T") else add("S")
        i += step
    return "".join(first), "".join(second)


def sounds_alike(a: str, b: str) -> bool:
    """Whether any code of a that is not empty is a code of b."""
    return bool(({*double_metaphone(a)} - {""}) & {*double_metaphone(b)})


def edit_budget(length: int) -> int:
    return 0 if length <= 4 else 1 if length <= 6 else 2 if length <= 10 else 3


def _stem(x: str) -> str:
    x = x[:-2] if x.endswith(("'s", "s'")) else x
    return x.removesuffix("s")


@lru_cache(maxsize=REMEMBERED)
def letter_bits(token: str) -> int:
    """Two bits for each of 32 groups of letters: whether the token has one of them, and whether it has two.

    An edit puts in, takes out or replaces one letter, so tokens that are d edits apart differ in at most 2 * d bits.
    """
    bits = 0
    for c in token.lower():
        bit = 1 << 2 * (ord(c) % 32)
        bits |= bit << 1 if bits & bit else bit
    return bits - (1 << 64) if bits >> 63 else bits


def letters_apart(a: str, b: str) -> int:
    """In how many letter_bits two tokens differ."""
    return ((letter_bits(a) ^ letter_bits(b)) & (1 << 64) - 1).bit_count()


@lru_cache(maxsize=REMEMBERED)
def similarity(a: str, b: str, phonetic: bool = True) -> tuple[bool, float, str]:
    """(match, score, reason) of two name tokens; a is the known name, b what was heard.

    Equal; equal without a plural or possessive; within the edit budget of the longer one; or, if phonetic, sounding
    alike and nearly within it. First letters must agree.
    """
    x, y = a.lower(), b.lower()
    if x == y:
        return True, 1.0, "exact"
    if not x or not y:
        return False, 0.0, "none"
    if _stem(x) == _stem(y):
        return True, 0.98, "exact"
    longer = max(len(x), len(y))
    budget = edit_budget(longer)
    if x[0] != y[0] or abs(len(x) - len(y)) > 3 or not budget:
        return False, 0.0, "none"
    apart = letters_apart(x, y)
    sounds = phonetic and len(x) >= 4 and apart <= 2 * (budget + 2) and sounds_alike(x, y)
    if apart > 2 * budget and not sounds:
        return False, 0.0, "none"
    distance = osa_distance(x, y)
    if distance <= budget:
        return True, 1 - distance / (longer + 1), "edit"
    if sounds and distance <= budget + 2:
        return True, 0.72, "phonetic"
    return False, 0.0, "none"


#: Longest text that osa_distances takes into its table; longer ones are compared one by one.
LONGEST_LETTERS = 32


def osa_distances(a: list[str], b: list[str], most: int) -> np.ndarray:
    """osa_distance of each a and the b at its place, most + 1 where it is more: one table for all pairs, of which only the cells near the diagonal are filled."""
    out = np.full(len(a), most + 1, np.int64)
    if not len(a):
        return out
    short = np.array([max(len(x), len(y)) <= LONGEST_LETTERS and "\0" not in x + y for x, y in zip(a, b, strict=True)], bool)
    for k in np.flatnonzero(~short):
        if abs(len(a[k]) - len(b[k])) <= most:
            out[k] = min(osa_distance.__wrapped__(a[k], b[k]), most + 1)
    rows = np.flatnonzero(short)
    if not len(rows):
        return out
    x, y = ([t[k] for k in rows] for t in (a, b))
    n, m = (np.fromiter(map(len, t), np.int64, len(rows)) for t in (x, y))
    wide = int(max(n.max(), m.max(), 1))
    u, v = (np.ascontiguousarray(np.array(t, f"<U{wide}").view(np.uint32).reshape(len(rows), wide).T) for t in (x, y))
    far = np.int8(most + 1)
    # cell o of row i is what the first i letters of a and the first i + o - most of b are apart
    band = [np.full(len(rows), min(o - most, most + 1) if o >= most else far, np.int8) for o in range(2 * most + 1)]
    before = None
    found = np.full(len(rows), far, np.int8)

    def note(i):
        for o, cell in enumerate(band):
            here = (n == i) & (m == i + o - most)
            found[here] = cell[here]

    note(0)
    for i in range(1, int(n.max()) + 1):
        row = []
        for o in range(2 * most + 1):
            j = i + o - most
            if j < 0 or j > wide:
                row.append(np.full(len(rows), far, np.int8))
                continue
            if j == 0:
                row.append(np.full(len(rows), min(i, far), np.int8))
                continue
            cell = band[o] + (u[i - 1] != v[j - 1])
            if o < 2 * most:
                cell = np.minimum(cell, band[o + 1] + np.int8(1))
            if o:
                cell = np.minimum(cell, row[o - 1] + np.int8(1))
            if i > 1 and j > 1:
                swapped = (u[i - 1] == v[j - 2]) & (u[i - 2] == v[j - 1])
                cell = np.where(swapped, np.minimum(cell, before[o] + np.int8(1)), cell)
            row.append(np.minimum(cell, far))
        before, band = band, row
        note(i)
    out[rows] = found
    return out


def similarities(a: list[str], b: list[str], phonetic: bool = True) -> pd.DataFrame:
    """similarity of each a and the b at its place, as columns: edits are counted for all pairs at once."""
    x, y = [t.lower() for t in a], [t.lower() for t in b]
    match, score, reason = np.zeros(len(x), bool), np.zeros(len(x)), np.full(len(x), "none", object)
    ask = []
    for k, (p, q) in enumerate(zip(x, y, strict=True)):
        if p == q:
            match[k], score[k], reason[k] = True, 1.0, "exact"
        elif p and q:
            if _stem(p) == _stem(q):
                match[k], score[k], reason[k] = True, 0.98, "exact"
            elif p[0] == q[0] and abs(len(p) - len(q)) <= 3 and max(len(p), len(q)) > 4:
                ask.append(k)
    most = 3 + 2 * phonetic
    for k, distance in zip(ask, osa_distances([x[k] for k in ask], [y[k] for k in ask], most).tolist(), strict=True):
        longer = max(len(x[k]), len(y[k]))
        budget = edit_budget(longer)
        if distance <= budget:
            match[k], score[k], reason[k] = True, 1 - distance / (longer + 1), "edit"
        elif phonetic and len(x[k]) >= 4 and distance <= budget + 2 and sounds_alike(x[k], y[k]):
            match[k], score[k], reason[k] = True, 0.72, "phonetic"
    return pd.DataFrame({"match": match, "score": score, "reason": reason})


#: Letters after the first of which a key may leave out some. Of longer tokens the others play no part in keys, so
#: that a token has at most 64 of them; texts within an edit distance have beginnings that share a key (see token_keys).
KEY_LETTERS = 7


def edit_depth(length: int) -> int:
    """The largest edit budget that a token of this length may have with another, which is longer by no more than it."""
    return max(edit_budget(n) for n in range(length, length + 4) if n - length <= edit_budget(n))


@lru_cache(maxsize=REMEMBERED_KEYS)
def token_keys(token: str, phonetic: bool = True) -> tuple[str, ...]:
    """Keys of a token: any two tokens that similarity() matches, but for equal ones, share one.

    Tokens within d edits become equal when each leaves out at most d letters, a swap of neighbours too. So do their
    beginnings: the one that keeps more letters of what they share leaves out its last ones instead, and
    the counts stay within d. First letters agree, so they are never left out. Other keys are the token
    without a plural or possessive, and its sounds.
    """
    x = token.lower()
    if not x:
        return ()
    tail, keys = x[1 : 1 + KEY_LETTERS], {"~" + _stem(x)}
    if depth := edit_depth(len(x)):
        for out in range(min(depth, len(tail)) + 1):
            keys.update(x[0] + "".join(kept) for kept in combinations(tail, len(tail) - out))
    if phonetic:
        keys.update(f"#{x[0]}{code}" for code in double_metaphone(x) if code)
    return tuple(sorted(keys))


def _osa(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else osa_distance(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


def _metaphone(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for s in batches:
        yield pd.DataFrame([double_metaphone(x or "") for x in s], columns=["primary", "alternate"])


def _similar(a: pd.Series, b: pd.Series, phonetic: bool = True) -> pd.DataFrame:
    return similarities([x or "" for x in a], [y or "" for y in b], phonetic)


_CODES = T.StructType([T.StructField("primary", T.StringType()), T.StructField("alternate", T.StringType())])
_LETTERS = T.StructType([T.StructField("letters", T.LongType()), *_CODES.fields])
_RESULT = T.StructType([T.StructField("match", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("reason", T.StringType())])


def osa_distance_udf(a: Column, b: Column) -> Column:
    return F.pandas_udf(_osa, T.IntegerType())(a, b)


def double_metaphone_udf(word: Column) -> Column:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        return _metaphone(batches)

    return F.pandas_udf(run, _CODES)(word)


def similarity_udf(known: Column, heard: Column, phonetic: bool = True) -> Column:
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return _similar(a, b, phonetic)

    return F.pandas_udf(run, _RESULT)(known, heard)


def letters_and_sounds_udf(token: Column) -> Column:
    """letter_bits and both Double Metaphone codes of a token, as similarity() has them."""

    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(letter_bits(x or ""), *double_metaphone((x or "").lower())) for x in s], columns=["letters", "primary", "alternate"])

    return F.pandas_udf(run, _LETTERS)(token)


def token_keys_udf(token: Column, phonetic: bool = True) -> Column:
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([list(token_keys(x or "", phonetic)) for x in s], dtype=object)

    return F.pandas_udf(run, T.ArrayType(T.StringType()))(token)


def register(spark: SparkSession) -> None:
    """osa_distance, double_metaphone and name_similarity for SQL."""

    def similar(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return _similar(a, b)

    def osa(a: pd.Series, b: pd.Series) -> pd.Series:
        return _osa(a, b)

    def codes(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([double_metaphone(x or "") for x in s], columns=["primary", "alternate"])

    spark.udf.register("osa_distance", F.pandas_udf(osa, T.IntegerType()))
    spark.udf.register("double_metaphone", F.pandas_udf(codes, _CODES))
    spark.udf.register("name_similarity", F.pandas_udf(similar, _RESULT))


def edit_budget_col(length: Column) -> Column:
    return F.when(length <= 4, 0).when(length <= 6, 1).when(length <= 10, 2).otherwise(3)
