"""Word-level column builders (normalising, skeletons, keys, tokenising)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from unbrev.profile import CASE_ALIASES, Profile

# The symbols that hide the inside of a masked word, in order.
MASK_SYMBOLS = "@#&%$!*"

# Spark's trim() only strips spaces; these strip every Unicode blank.
_EDGE_BLANKS = r"(?U)^\s+|\s+$"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, _EDGE_BLANKS, "")


def normalize(c: Column, profile: Profile) -> Column:
    return F.translate(F.lower(c), profile.fold_from, profile.fold_to)


def normalize_stored(c: Column, profile: Profile) -> Column:
    """:func:`normalize` of a column that is no long expression itself: text without
    anything but ASCII is not folded letter by letter.

    The column is repeated in it, so nested uses would multiply.
    """
    low = F.lower(c)
    if profile.fold_from.isascii():
        return normalize(c, profile)
    # As many bytes as characters: plain ASCII.
    plain = F.octet_length(low) == F.length(low)
    return F.when(plain, low).otherwise(normalize(c, profile))


def skeleton(norm: Column, profile: Profile) -> Column:
    return F.translate(norm, profile.vowels + profile.signs, "")


def is_vowel(ch: Column, profile: Profile) -> Column:
    return F.instr(F.lit(profile.vowels), ch) > 0


def is_sign(ch: Column, profile: Profile) -> Column:
    if not profile.signs:
        return F.lit(False)
    return F.instr(F.lit(profile.signs), ch) > 0


def is_plain_word(norm: Column, profile: Profile) -> Column:
    """Letters with single inner hyphens; the empty string passes."""
    part = f"[{profile.letter_class}{profile.fold_from if profile.name == 'ru' else ''}]+"
    return norm.rlike(f"^({part}(-{part})*)?$")


def is_lexicon_word(word: Column, profile: Profile) -> Column:
    """Non-empty letters and hyphens in any position."""
    return word.rlike(f"^[{profile.raw_letter_class}-]+$")


def delete_variants(key: Column, min_len: int = 3) -> Column:
    """Distinct strings with one character removed; none for short keys."""
    n = F.length(key)
    variants = F.transform(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
        lambda i: F.concat(
            F.substring(key, F.lit(1), i - 1), F.substring(key, i + 1, n)
        ),
    )
    none = F.array().cast("array<string>")
    return F.when(n >= min_len, F.array_distinct(variants)).otherwise(none)


def prefixes(key: Column, min_len: int = 1) -> Column:
    """Every prefix of ``key`` that has at least ``min_len`` characters."""
    n = F.length(key)
    found = F.transform(
        F.sequence(F.lit(min_len), F.greatest(n, F.lit(min_len))),
        lambda i: F.substring(key, F.lit(1), i),
    )
    return F.when(n >= min_len, found).otherwise(F.array().cast("array<string>"))


def known_ending(norm: Column, profile: Profile) -> Column:
    """Longest known ending of the word, null when there is none."""
    ordered = sorted(profile.endings, key=lambda e: -len(e))
    return F.coalesce(*[F.when(norm.endswith(e), F.lit(e)) for e in ordered])


def known_endings(norm: Column, profile: Profile) -> Column:
    """All known endings of the word, as an array."""
    hits = F.array(*[F.when(norm.endswith(e), F.lit(e)) for e in profile.endings])
    return F.array_compact(hits)


def common_prefix_len(a: Column, b: Column) -> Column:
    n = F.least(F.length(a), F.length(b))
    same = F.filter(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
        lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i),
    )
    return F.when(n > 0, F.size(same)).otherwise(F.lit(0))


def common_ending_len(a: Column, b: Column) -> Column:
    """Shared trailing characters, at most three."""

    def same(k: int) -> Column:
        fits = (F.length(a) >= k) & (F.length(b) >= k)
        return fits & (F.right(a, F.lit(k)) == F.right(b, F.lit(k)))

    return (
        F.when(same(3), 3).when(same(2), 2).when(same(1), 1).otherwise(0)
    )


def skeleton_match(input_skel: Column, form_skel: Column) -> Column:
    """1 for equal skeletons, else the matched share of the input's skeleton."""
    share = common_prefix_len(input_skel, form_skel) / F.length(input_skel)
    return (
        F.when(input_skel == form_skel, F.lit(1.0))
        .when(input_skel == "", F.lit(0.0))
        .otherwise(share)
    )


def grammatical_case(tags: Column) -> Column:
    """First case grammeme of a tag string, null when it has none."""
    names = F.array(*[F.lit(k) for k in CASE_ALIASES])
    lookup = F.create_map(*[F.lit(x) for kv in CASE_ALIASES.items() for x in kv])
    hits = F.filter(F.split(tags, "[, ]"), lambda t: F.array_contains(names, t))
    return F.element_at(lookup, F.get(hits, F.lit(0)))


def governed_cases(prep: Column, profile: Profile) -> Column:
    """Cases that a normalised preposition governs, null for other words."""
    if not profile.government:
        return F.lit(None).cast("array<string>")
    pairs: list[Column] = []
    for word, cases in profile.government.items():
        pairs += [F.lit(word), F.array(*[F.lit(c) for c in cases])]
    return F.element_at(F.create_map(*pairs), prep)


def case_agreement(prev: Column, tags: Column, profile: Profile) -> Column:
    """1 when the form's case is governed by the preceding word, else 0."""
    if not profile.government:
        return F.lit(0.0)
    fits = F.array_contains(governed_cases(prev, profile), grammatical_case(tags))
    return F.when(F.coalesce(fits, F.lit(False)), 1.0).otherwise(0.0)


def context_key(word: Column, profile: Profile) -> Column:
    """Normalised word with non-letters trimmed off both ends."""
    letters = profile.letter_class
    return F.regexp_replace(
        normalize(word, profile), f"^[^{letters}]+|[^{letters}]+$", ""
    )


def last_context_key(context: Column, profile: Profile) -> Column:
    """Key of the most recent context word that still has letters."""
    keys = F.filter(
        F.transform(context, lambda w: context_key(w, profile)), lambda k: k != ""
    )
    return F.coalesce(F.get(keys, F.size(keys) - 1), F.lit(""))


def last_context_word(context: Column, profile: Profile) -> Column:
    """The last raw context word, trimmed and normalised only."""
    last = F.get(context, F.size(context) - 1)
    return F.coalesce(normalize(strip(last), profile), F.lit(""))


def mask_form(form: Column) -> Column:
    """Hide the inside of a word; null when it is too short to hide anything.

    The first third of the letters (rounded up) and the last letter stay;
    hyphens stay and are not counted.
    """
    letters = F.length(F.translate(form, "-", ""))
    head = F.greatest(F.ceil(letters / 3), F.lit(1))

    def cover(ch: Column, i: Column) -> Column:
        at = F.length(F.translate(F.substring(form, F.lit(1), i), "-", ""))
        symbol = F.substring(
            F.lit(MASK_SYMBOLS),
            ((at - head) % len(MASK_SYMBOLS) + 1).cast("int"),
            F.lit(1),
        )
        inside = (ch != "-") & (at >= head) & (at < letters - 1)
        return F.when(inside, symbol).otherwise(ch)

    masked = F.array_join(F.transform(F.split(form, ""), cover), "")
    return F.when(head + 1 < letters, masked)


def corpus_tokens(line: Column, profile: Profile) -> Column:
    """Tokens of one corpus line: runs of letters and hyphens, normalised."""
    runs = F.split(normalize_stored(line, profile), f"[^{profile.letter_class}-]+")
    return F.filter(runs, lambda t: ~t.isin("", "-"))


def word_tokens(text: Column, profile: Profile) -> Column:
    """Words with single inner hyphens, found in raw text, then normalised."""
    one = f"[{profile.raw_letter_class}]+"
    found = F.regexp_extract_all(text, F.lit(f"{one}(?:-{one})*"), F.lit(0))
    return F.transform(found, lambda w: normalize(w, profile))


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, "<[^>]+>", " ")


def trailing_token(text: Column, profile: Profile) -> Column:
    """The run of word characters that ends the text (may be empty)."""
    return F.regexp_extract(text, f"[{profile.raw_letter_class}-]*$", 0)


def words_in(text: Column, profile: Profile) -> Column:
    """All runs of letters and hyphens of a text, as written."""
    runs = F.split(text, f"[^{profile.raw_letter_class}-]+")
    return F.filter(runs, lambda w: w != "")


def previous_words(prefix: Column, profile: Profile, limit: int = 3) -> Column:
    """Up to ``limit`` last words of the text before a token."""
    words = words_in(prefix, profile)
    return F.slice(
        words,
        F.greatest(F.size(words) - limit + 1, F.lit(1)),
        F.lit(limit),
    )


def tokens_with_context(text: Column, profile: Profile, limit: int = 3) -> Column:
    """All words of a text with the words before each of them.

    Returns ``array<struct<pos, token, context>>``; ``pos`` counts from 1.
    The words before come from shifted copies of the list, so the work grows
    with the text, not with its square.
    """
    words = words_in(text, profile)
    gap = F.array(F.lit(None).cast("string"))

    def shifted(k: int) -> Column:
        return F.concat(*[gap] * k, words).alias(f"p{k}")

    names = [f"p{k}" for k in range(limit, 0, -1)]
    zipped = F.arrays_zip(words.alias("token"), *[shifted(k) for k in range(1, limit + 1)])
    return F.transform(
        F.filter(zipped, lambda z: z["token"].isNotNull()),
        lambda z, i: F.struct(
            (i + 1).alias("pos"),
            z["token"].alias("token"),
            F.array_compact(F.array(*[z[n] for n in names])).alias("context"),
        ),
    )


def title_case_name(name: Column) -> Column:
    """Capitalise each hyphen-separated part of a name."""
    return F.array_join(F.transform(F.split(name, "-"), F.initcap), "-")


def keyboard_adjacent(a: Column, b: Column, profile: Profile) -> Column:
    pairs = "|".join(x + y for x, near in profile.neighbours.items() for y in near)
    both = (F.length(a) == 1) & (F.length(b) == 1)
    return both & (F.instr(F.lit(pairs), F.concat(a, b)) > 0)


def keyboard_neighbours(ch: Column, profile: Profile) -> Column:
    """String of the letters next to ``ch`` on the keyboard."""
    lookup = F.create_map(*[F.lit(x) for kv in profile.neighbours.items() for x in kv])
    return F.coalesce(F.element_at(lookup, ch), F.lit(""))


def uniform(*parts: Column | str | int) -> Column:
    """A number in [0, 1) that depends only on the given values.

    Every engine with md5 gets the same number, and a lost task that runs again
    draws it again, which a seeded generator per partition does not promise.
    """
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    digest = F.md5(F.concat_ws(":", *cols))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 2**32
