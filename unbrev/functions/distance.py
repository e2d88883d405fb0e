"""Weighted edit distance from a typed input to a candidate form.

The distance is directed: an "insertion" is a character of the form that the
input left out, which is cheap for vowels and signs.  All values are whole
twentieths (see :mod:`unbrev.settings`).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from unbrev.functions import text as tx
from unbrev.profile import Profile
from unbrev.settings import EditCosts, Settings

_ASTRAL = 0x10000
_BLOCK = 2048
Codes = tuple[np.ndarray, np.ndarray]  # code points by row, word lengths


def cutoff(input_norm: Column, settings: Settings) -> Column:
    return settings.cutoff_base + settings.cutoff_per_char * F.length(input_norm)


def length_bound(
    n: np.ndarray, in_cons: np.ndarray, m: np.ndarray, form_cons: np.ndarray, costs: EditCosts
) -> np.ndarray:
    """A value no distance can be below, from lengths and skeleton lengths of
    the inputs (``n, in_cons``) and the forms (``m, form_cons``).

    At most ``min(n, m)`` characters pair up.  Consonants of the form beyond
    those of the input pair with one of the input's other characters (at least
    the cheapest substitution) or are inserted; characters of the form beyond
    the input's length are inserted, at the cheapest class if not consonants.
    Surplus input consonants and characters are treated the same way.  Valid
    for costs that pass :func:`bound_applies`.
    """
    swap = min(costs.substitute_neighbour, costs.substitute_vowel, costs.substitute)
    small = min(costs.insert_vowel, costs.insert_sign, costs.insert_consonant)
    extra = np.maximum(form_cons - in_cons, 0)
    swapped = np.minimum(extra, n - in_cons)
    inserted = extra - swapped
    grown = (
        costs.insert_consonant * inserted
        + swap * swapped
        + small * np.maximum(m - n - inserted, 0)
    )
    surplus = np.maximum(in_cons - form_cons, 0)
    covered = np.minimum(surplus, m - form_cons)
    shrunk = np.maximum(
        swap * covered + costs.delete * (surplus - covered),
        costs.delete * np.maximum(n - m, 0),
    )
    return np.maximum(grown, shrunk)


def bound_applies(costs: EditCosts) -> bool:
    swap = min(costs.substitute_neighbour, costs.substitute_vowel, costs.substitute)
    small = min(costs.insert_vowel, costs.insert_sign, costs.insert_consonant)
    return costs.insert_consonant >= swap + small and costs.delete >= swap


# Letters at the start and at the end of a word that a sketch holds, and bits for each.
_HEAD, _TAIL, _BITS = 5, 3, 6
SKETCH = ("size", "cons", "head", "skel_head", "tail", "has", "reach")


def sketch(norm: Column, skel: Column, profile: Profile, prefix: str) -> list[Column]:
    """Numbers of a word, named ``prefix`` and :data:`SKETCH`, from which a pair is bounded
    without its letters: lengths, first and last letters, the set of letters and the set
    of letters that a cheap swap can make of them.  Letters outside the alphabet count as
    equal, or not at all.
    """
    letters = "".join(sorted(set(profile.letters + profile.vowels + profile.signs)))[: 2**_BITS - 1]

    def near(a: str, b: str) -> bool:
        return a == b or profile.adjacent(a, b) or (a in profile.vowels and b in profile.vowels)

    def packed(word: Column, count: int, back: bool) -> Column:
        n, total = F.length(word), F.lit(0).cast("bigint")
        for i in range(count):
            letter = F.instr(F.lit(letters), F.substring(word, n - i if back else F.lit(i + 1), F.lit(1)))
            code = F.when(n > i, letter).otherwise(0).cast("bigint")
            total = total + code * F.lit(2 ** (_BITS * (count - 1 - i))).cast("bigint")
        return total

    def masked(bits: dict[str, int]) -> Column:
        mask = F.lit(0).cast("bigint")
        for ch, value in bits.items():
            hit = F.when(F.instr(norm, F.lit(ch)) > 0, F.lit(value)).otherwise(F.lit(0))
            mask = mask.bitwiseOR(hit.cast("bigint"))
        return mask

    own = {ch: 1 << i for i, ch in enumerate(letters)}
    reach = {ch: sum(own[o] for o in letters if near(ch, o) or near(o, ch)) for ch in letters}
    values = (
        F.length(norm), F.length(skel), packed(norm, _HEAD, False), packed(skel, _HEAD, False),
        packed(norm, _TAIL, True), masked(own), masked(reach),
    )
    return [v.alias(f"{prefix}{name}") for v, name in zip(values, SKETCH)]


def _agreeing(a: str, b: str, count: int, whole: Column) -> Column:
    """At least as many letters as two packed words share from their start."""
    x = F.col(a).bitwiseXOR(F.col(b))
    shared = F.when(x == 0, whole)
    for k in range(1, count):
        shared = shared.when(x < 2 ** (_BITS * k), count - k)
    return shared.otherwise(0)


def most_shared(typed: str, form: str) -> tuple[Column, Column, Column]:
    """No less than the shared letters of two sketched words: first ones, first ones of the
    skeletons, last ones."""
    return (
        _agreeing(f"{typed}head", f"{form}head", _HEAD, F.col(f"{typed}size")),
        _agreeing(f"{typed}skel_head", f"{form}skel_head", _HEAD, F.col(f"{typed}cons")),
        _agreeing(f"{typed}tail", f"{form}tail", _TAIL, F.lit(_TAIL)),
    )


def least_distance(typed: str, form: str, profile: Profile, costs: EditCosts) -> Column:
    """No more than the distance of two sketched words.

    Letters of the input that the form lacks are deleted or swapped, letters of the form
    that the input lacks are inserted or swapped, each at the full price unless the other
    word has a letter for a cheap swap; what one word has more of is deleted or inserted.
    """
    letters = "".join(sorted(set(profile.letters + profile.vowels + profile.signs)))[: 2**_BITS - 1]
    swap = min(costs.substitute_neighbour, costs.substitute_vowel, costs.substitute)

    def bits(chars: str) -> int:
        return sum(1 << i for i, ch in enumerate(letters) if ch in chars)

    def lacking(own: str, other: str, price: int, among: int) -> Column:
        def count(others: str) -> Column:
            rest = F.col(f"{own}has").bitwiseAND(F.bitwise_not(F.col(f"{other}{others}")))
            return F.bit_count(rest.bitwiseAND(F.lit(among).cast("bigint")))

        near, far = min(price, swap), min(price, costs.substitute)
        return count("has") * near + count("reach") * max(far - near, 0)

    silent = set(profile.vowels + profile.signs)
    gone = lacking(typed, form, costs.delete, bits(letters))
    come = lacking(form, typed, costs.insert_consonant, bits("".join(set(letters) - silent)))
    soft = min(costs.insert_vowel, costs.insert_sign, swap)
    absent = F.col(f"{form}has").bitwiseAND(F.bitwise_not(F.col(f"{typed}has")))
    come = come + F.bit_count(absent.bitwiseAND(F.lit(bits("".join(silent))).cast("bigint"))) * soft
    n, in_cons, m, form_cons = (F.col(f"{w}{c}") for w in (typed, form) for c in ("size", "cons"))
    # Short, since a join evaluates it for every pair.
    grown = (m - n) * min(soft, costs.insert_consonant)
    return F.greatest(gone, come, (n - m) * costs.delete, grown, (form_cons - in_cons) * min(swap, costs.insert_consonant))


def _char_tables(profile: Profile, costs: EditCosts) -> tuple[np.ndarray, ...]:
    """Per-character insertion costs, alphabet slots and the swap cost table."""
    known = sorted(set(profile.letters + profile.vowels + profile.signs))
    slot = np.zeros(_ASTRAL, dtype=np.int32)
    insert = np.full(_ASTRAL, costs.insert_consonant, dtype=np.int32)
    swap = np.full((len(known) + 1,) * 2, costs.substitute, dtype=np.int32)
    for i, a in enumerate(known, start=1):
        slot[ord(a)] = i
        if a in profile.vowels:
            insert[ord(a)] = costs.insert_vowel
        elif a in profile.signs:
            insert[ord(a)] = costs.insert_sign
        for j, b in enumerate(known, start=1):
            if profile.adjacent(a, b):
                swap[i, j] = costs.substitute_neighbour
            elif a in profile.vowels and b in profile.vowels:
                swap[i, j] = costs.substitute_vowel
    return slot, insert, swap


def _code_points(words: pd.Series) -> Codes:
    flat = words.to_numpy(dtype=str)
    width = max(flat.dtype.itemsize // 4, 1)
    codes = flat.view(np.uint32).reshape(len(flat), width)
    return codes, (codes != 0).sum(axis=1)




def pair_distances(
    inputs: Codes, forms: Codes, tables: tuple[np.ndarray, ...], costs: EditCosts
) -> np.ndarray:
    """Distances of aligned word pairs, a few thousand pairs at a time."""
    (a, n), (b, m) = inputs, forms
    parts = [
        _distance_block(
            *_cut(a[i : i + _BLOCK], n[i : i + _BLOCK]),
            *_cut(b[i : i + _BLOCK], m[i : i + _BLOCK]),
            tables,
            costs,
        )
        for i in range(0, len(a), _BLOCK)
    ]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32)


def _cut(codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return codes[:, : max(int(sizes.max(initial=0)), 1)], sizes


def _distance_block(
    a: np.ndarray,
    n: np.ndarray,
    b: np.ndarray,
    m: np.ndarray,
    tables: tuple[np.ndarray, ...],
    costs: EditCosts,
) -> np.ndarray:
    """One step per input position for all pairs of the block.

    The left-to-right dependence of a row (insertions) becomes a running
    minimum after subtracting the summed insertion costs of the form.
    """
    slot, insert, swap = tables
    width = swap.shape[0]
    flat = swap.ravel()
    a_slot = slot[np.minimum(a, _ASTRAL - 1)] * width
    b_code = np.minimum(b, _ASTRAL - 1)
    b_slot = slot[b_code]
    rows = np.arange(len(a))
    spent = np.zeros((len(a), b.shape[1] + 1), dtype=np.int32)
    np.cumsum(insert[b_code], axis=1, out=spent[:, 1:])

    before, prev = None, spent.copy()
    out = prev[rows, m].copy()
    for i in range(int(n.max(initial=0))):
        ch = a[:, i, None]
        cost = flat.take(a_slot[:, i, None] + b_slot)
        cost[b == ch] = 0
        row = prev + costs.delete
        np.minimum(row[:, 1:], prev[:, :-1] + cost, out=row[:, 1:])
        if before is not None:
            at, to = np.nonzero((b[:, :-1] == ch) & (b[:, 1:] == a[:, i - 1, None]))
            row[at, to + 2] = np.minimum(
                row[at, to + 2], before[at, to] + costs.transpose
            )
        row -= spent
        np.minimum.accumulate(row, axis=1, out=row)
        row += spent
        done = np.nonzero(n == i + 1)[0]
        out[done] = row[done, m[done]]
        before, prev = prev, row
    return out


def _shared_prefix(x: Codes, y: Codes) -> np.ndarray:
    (a, n), (b, m) = x, y
    width = min(a.shape[1], b.shape[1])
    same = np.logical_and.accumulate(a[:, :width] == b[:, :width], axis=1).sum(axis=1)
    return np.minimum(same, np.minimum(n, m))


COMPARISON = "distance int, prefix int, skel_prefix int"
TOO_FAR = -1


def compare_udf(profile: Profile, settings: Settings = Settings()):
    """Distance and shared prefix lengths of (input, form, input skeleton,
    form skeleton), all in one pass over the batch.

    The distance is :data:`TOO_FAR` where it exceeds the cutoff; pairs whose
    lower bound already does are not worked out.
    """
    costs = settings.costs
    tables = _char_tables(profile, costs)
    bounded = bound_applies(costs)

    @F.pandas_udf(COMPARISON)
    def compare(
        inputs: pd.Series, forms: pd.Series, in_skels: pd.Series, form_skels: pd.Series
    ) -> pd.DataFrame:
        typed, form = _code_points(inputs), _code_points(forms)
        typed_skel, form_skel = _code_points(in_skels), _code_points(form_skels)
        n = typed[1]
        limit = settings.cutoff_base + settings.cutoff_per_char * n
        out = np.full(len(n), TOO_FAR, dtype=np.int32)
        near = np.arange(len(n))
        if bounded:
            bound = length_bound(n, typed_skel[1], form[1], form_skel[1], costs)
            near = np.nonzero(bound <= limit)[0]
        found = pair_distances(
            (typed[0][near], n[near]), (form[0][near], form[1][near]), tables, costs
        )
        out[near] = np.where(found <= limit[near], found, TOO_FAR)
        return pd.DataFrame(
            {
                "distance": out,
                "prefix": _shared_prefix(typed, form),
                "skel_prefix": _shared_prefix(typed_skel, form_skel),
            }
        )

    # Marked so that a filter on the result is not moved below it and run as a
    # second evaluation.
    return compare.asNondeterministic()


def edit_distance(
    input_norm: Column,
    form_norm: Column,
    profile: Profile,
    costs: EditCosts = EditCosts(),
) -> Column:
    """Distance column in twentieths, computed per Arrow batch of pairs."""
    return distance_udf(profile, costs)(input_norm, form_norm)


def distance_udf(profile: Profile, costs: EditCosts = EditCosts()):
    tables = _char_tables(profile, costs)

    @F.pandas_udf(T.IntegerType())
    def distance(inputs: pd.Series, forms: pd.Series) -> pd.Series:
        return pd.Series(
            pair_distances(_code_points(inputs), _code_points(forms), tables, costs)
        )

    return distance


def edit_distance_native(
    input_norm: Column,
    form_norm: Column,
    profile: Profile,
    costs: EditCosts = EditCosts(),
) -> Column:
    """The same distance from built-in functions only (slower; for SQL views)."""

    def price(ch: Column) -> Column:
        return (
            F.when(tx.is_vowel(ch, profile), costs.insert_vowel)
            .when(tx.is_sign(ch, profile), costs.insert_sign)
            .otherwise(costs.insert_consonant)
        )

    def swap(x: Column, y: Column) -> Column:
        vowels = tx.is_vowel(x, profile) & tx.is_vowel(y, profile)
        return (
            F.when(x == y, 0)
            .when(tx.keyboard_adjacent(x, y, profile), costs.substitute_neighbour)
            .when(vowels, costs.substitute_vowel)
            .otherwise(costs.substitute)
        )

    def ch(word: Column, i: Column) -> Column:
        return F.substring(word, i, F.lit(1))

    n, m = F.length(input_norm), F.length(form_norm)
    positions = F.filter(F.sequence(F.lit(0), m), lambda j: j > 0)
    first = F.aggregate(
        positions,
        F.array(F.lit(0)),
        lambda row, j: F.concat(
            row, F.array(F.get(row, j - 1) + price(ch(form_norm, j)))
        ),
    )

    def next_row(state: Column, i: Column) -> Column:
        prev, before = state["prev"], state["before"]
        here = ch(input_norm, i)

        def cell(row: Column, j: Column) -> Column:
            there = ch(form_norm, j)
            crossed = (
                (i > 1)
                & (j > 1)
                & (here == ch(form_norm, j - 1))
                & (ch(input_norm, i - 1) == there)
            )
            options = [
                F.get(prev, j - 1) + swap(here, there),
                F.get(prev, j) + costs.delete,
                F.get(row, j - 1) + price(there),
                F.when(crossed, F.get(before, j - 2) + costs.transpose),
            ]
            return F.concat(row, F.array(F.least(*options)))

        row = F.aggregate(
            positions, F.array(F.get(prev, F.lit(0)) + costs.delete), cell
        )
        return F.struct(row.alias("prev"), prev.alias("before"))

    return F.aggregate(
        F.filter(F.sequence(F.lit(0), n), lambda i: i > 0),
        F.struct(first.alias("prev"), first.alias("before")),
        next_row,
        lambda state: F.get(state["prev"], m),
    )
