"""Names and addresses to canonical tokens, as column expressions.

Every step is a (pattern, replacement) pair without look-around, so that the same list also makes the SQL that the queries are
held against. What needs a state machine is in ``kindred.functions.records``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kindred.functions.lexicons import CANON, DBA, DROP, LANDMARK, LEADING_LEGAL, LEGAL, MARKED, PLAIN, SPELLED, STATES, TLDS

INDIC = r"[\x{0900}-\x{0D7F}]"
#: Steps of a token string after folding; a replacement's \1 is the first group.
STEPS = (
    (r"([a-z0-9])'s( |$)", r"\1\2"),
    (r"(^| )(l|d|qu|j|m|n|s|t|c)'", r"\1"),
    (r"'", ""),
    (r"[&+]", " and "),
    (r"(^| )([a-z])\.([a-z])\.?( |$)", r"\1\2\3\4"),
    (r"(^| )([0-9]+)(st|nd|rd|th|er|eme)( |$)", r"\1\2\4"),
    (r"([0-9])([a-z])", r"\1 \2"),
    (r"([a-z])([0-9])", r"\1 \2"),
    (r"[^a-z0-9]+", " "),
)
CODE_STEPS = (
    (r"(^|[^0-9])([0-9]{3}) ([0-9]{3})($|[^0-9])", r"\1\2\3\4"),
    (r"(^|[^0-9])0+([1-9])", r"\1\2"),
)
ADDRESS_STEPS = (
    *CODE_STEPS,
    *((rf"(^|[^a-z]){k}($|[^a-z])", rf"\1{v}\2") for k, v in sorted(STATES.items(), key=lambda kv: (-len(kv[0]), kv[0]))),
)
#: Letters that stand for digits inside a word.
LEET = (("0", "o"), ("1", "l"), ("3", "e"), ("4", "a"), ("5", "s"), ("7", "t"), ("8", "b"))
_TLD = "|".join(sorted(TLDS, key=lambda t: (-len(t), t)))
DOMAIN = rf"[a-z0-9][a-z0-9-]*(?:\.[a-z0-9-]+)*\.(?:{_TLD})"
#: The label before a domain's ending, a handle, and the marks that go where there is one of either.
LABEL = rf"([^\s|()\[\]@#.]+)\.(?:{_TLD})\b"
HANDLE = r"(?:^|\s)[@#]+(\S+)"
MARKS = rf"\bwww\.|\.(?:{_TLD})\b|(?:^|\s)[@#]+"
_FORMS = "|".join(" ".join(f) for f in LEGAL)
_LEADS = "|".join(LEADING_LEGAL)
#: The legal forms that end a name, a word staying; and those that begin it, two words staying. Neither pattern repeats over the
#: words of a name, which may be very many.
TRAILING = rf"((?: (?:{_FORMS}))+)$"
LEADING = rf"^((?:(?:{_LEADS}) )+)[^ ]+ [^ ]"
SKELETON = (
    (r"c([eiy])", r"s\1"),
    (r"g([eiy])", r"j\1"),
    ("ph", "f"), ("ck", "k"), ("sh", "s"), ("q", "k"), ("x", "ks"), ("z", "s"), ("w", "v"), ("b", "v"), ("y", "i"),
    (r"([cdfgjklmnpqrstv])h", r"\1"),
    ("c", "k"),
)


def steps(c: Column, list_: tuple[tuple[str, str], ...]) -> Column:
    for pattern, to in list_:
        c = F.regexp_replace(c, pattern, to.replace("\\", "$"))
    return c


def steps_sql(expr: str, list_: tuple[tuple[str, str], ...]) -> str:
    q = lambda s: s.replace("'", "''")
    for pattern, to in list_:
        expr = f"regexp_replace({expr}, '{q(pattern)}', '{q(to)}', 'g')"
    return expr


def has_indic(c: Column) -> Column:
    return c.rlike(INDIC)


def fold_latin(c: Column) -> Column:
    """Lower case, marks off Latin letters, ligatures apart, one kind of apostrophe."""
    c = F.translate(F.lower(c), MARKED + "’‘`´", PLAIN + "''''")
    return F.replace(F.replace(F.replace(c, F.lit("ß"), F.lit("ss")), F.lit("æ"), F.lit("ae")), F.lit("œ"), F.lit("oe"))


def fold_latin_sql(expr: str) -> str:
    return f"replace(replace(replace(translate(lower({expr}), '{MARKED}’‘`´', '{PLAIN}'''''''''), 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe')"


def canon_map() -> Column:
    return F.create_map(*[F.lit(x) for kv in CANON.items() for x in kv])


def split_words(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda w: w != "")


def words(c: Column) -> Column:
    """The words of a folded string, not yet canonical."""
    return split_words(steps(c, STEPS))


def by_sound() -> dict[str, str]:
    """Skeleton -> canonical word, of words of five letters or more and skeletons of three; those of two canonical words are out."""
    from kindred.functions.records import skeleton as plain

    known: dict[str, set[str]] = {}
    for word, to in CANON.items():
        if len(word) >= 5 and len(plain(word)) >= 3:
            known.setdefault(plain(word), set()).add(to)
    return {k: min(v) for k, v in known.items() if len(v) == 1}


def canonical(ws: Column, foreign: Column | None = None) -> Column:
    """Canonical words, those that carry nothing dropped. Where ``foreign``, words were read from an Indic script, and one that isn't
    known stands for the canonical word that is spelled or sounds like it."""
    m = canon_map()
    one = lambda w: F.try_element_at(m, w)
    if foreign is not None:
        spelled, sounds = (F.create_map(*[F.lit(x) for kv in t.items() for x in kv]) for t in (SPELLED, by_sound()))
        heard = lambda w: F.when(foreign & ~w.rlike("^[0-9]+$"), F.coalesce(F.try_element_at(spelled, w), F.try_element_at(sounds, skeleton(w))))
        known = F.transform(ws, lambda w: F.coalesce(one(w), heard(w), w))
    else:
        known = F.transform(ws, lambda w: F.coalesce(one(w), w))
    return F.filter(known, lambda w: ~w.isin(*sorted(DROP)))


def tokens(c: Column) -> Column:
    """Canonical tokens of a folded string; words that carry nothing are dropped."""
    return canonical(words(c))


def words_sql(expr: str) -> str:
    return f"list_filter(string_split({steps_sql(expr, STEPS)}, ' '), lambda w: w <> '')"


def canonical_sql(ws: str) -> str:
    m = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in CANON.items()) + "}"
    drop = ", ".join(f"'{w}'" for w in sorted(DROP))
    return f"list_filter(list_transform({ws}, lambda w: coalesce({m}[w], w)), lambda w: w NOT IN ({drop}))"


def tokens_sql(expr: str) -> str:
    return canonical_sql(words_sql(expr))


def web_labels(c: Column) -> Column:
    """Labels of web domains before their ending, and handles, in letters and digits only."""
    found = F.concat(F.regexp_extract_all(c, F.lit(LABEL), F.lit(1)), F.regexp_extract_all(c, F.lit(HANDLE), F.lit(1)))
    return F.filter(F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, "[^a-z0-9]+", ""))), lambda x: x != "")


def without_web_marks(c: Column, labels: Column) -> Column:
    """``c`` without www, endings of domains and marks of handles, where it has any label."""
    return F.when(F.size(labels) > 0, F.regexp_replace(c, MARKS, " ")).otherwise(c)


def pieces(c: Column) -> Column:
    """The pieces of a name: what cues of a second name, bars and brackets part."""
    return F.split(F.regexp_replace(c, DBA, "|"), r"[|()\[\]]")


def legal_apart(ws: Column) -> Column:
    """(core, legal) of canonical words: forms at the end as long as a word is left, then at the beginning while more than two are."""
    def apart(t: Column) -> Column:
        tail = F.regexp_extract(t, TRAILING, 1)
        core = F.substring(t, F.lit(1), F.length(t) - F.length(tail))
        lead = F.regexp_extract(core, LEADING, 1)
        rest = core.substr(F.length(lead) + 1, F.length(core))
        forms = F.transform(F.regexp_extract_all(tail, F.lit(rf" ({_FORMS})\b"), F.lit(1)), lambda x: F.trim(x))
        return F.struct(split_words(rest).alias("core"), F.concat(forms, split_words(lead)).alias("legal"))

    return F.get(F.transform(F.array(F.array_join(ws, " ")), apart), F.lit(0))  # bound to a variable, patterns run on one string


def legal_sql(ws: str) -> tuple[str, str]:
    """SQL of (core, legal) of a list of canonical words."""
    t = f"array_to_string({ws}, ' ')"
    tail = f"regexp_extract({t}, '{TRAILING}', 1)"
    core = f"substr({t}, 1, length({t}) - length({tail}))"
    lead = f"regexp_extract({core}, '{LEADING}', 1)"
    rest = f"substr({core}, length({lead}) + 1)"
    split = lambda x: f"list_filter(string_split({x}, ' '), lambda w: w <> '')"
    return split(rest), rf"list_concat(regexp_extract_all({tail}, ' ({_FORMS})\b', 1), {split(lead)})"


def before_landmark(s: Column) -> Column:
    """What of a part of an address stands before the cue of a landmark; all of it without one."""
    return F.when(s.rlike(LANDMARK), F.regexp_extract(s, rf"^(.*?)(?:{LANDMARK})", 1)).otherwise(s)


def after_landmark(s: Column) -> Column:
    return F.regexp_extract(s, rf"(?:{LANDMARK})(.*)", 1)


def clean_address(c: Column) -> Column:
    """Folded address: postal codes in one piece, no zeros before house numbers, states abbreviated."""
    return address_steps(fold_latin(c))


def address_steps(c: Column) -> Column:
    """ADDRESS_STEPS; those of the states run only where one of their names stands."""
    c = steps(c, CODE_STEPS)
    by_letter: dict[str, list[str]] = {}
    for name in STATES:
        by_letter.setdefault(name[0], []).append(name[1:])
    names = "|".join(f"{a}(?:{'|'.join(rest)})" for a, rest in by_letter.items())  # a word of another letter is passed over at once
    one = lambda x: F.when(x.rlike(rf"(^|[^a-z])({names})($|[^a-z])"), steps(x, ADDRESS_STEPS[len(CODE_STEPS) :])).otherwise(x)
    return F.get(F.transform(F.array(c), one), F.lit(0))  # bound to a variable, the steps so far run once


def numbers(toks: Column) -> Column:
    """House numbers: digit tokens of fewer than five digits, without zeros before them, in order, once each."""
    return F.array_distinct(F.transform(F.filter(toks, lambda w: w.rlike("^[0-9]{1,4}$")), lambda w: F.regexp_replace(w, "^0+([0-9])", "$1")))


def postal(c: Column) -> Column:
    """Digit runs of five or more, in order, once each."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"[0-9]{5,}"), F.lit(0)))


def domains(c: Column) -> Column:
    """Web domains in a string, without a leading www."""
    return F.transform(F.regexp_extract_all(F.lower(c), F.lit(rf"({DOMAIN})"), F.lit(1)), lambda x: F.regexp_replace(x, r"^www\.", ""))


def repair_digits(c: Column) -> Column:
    """Digits between letters that stand for letters (hospita1ity); twice, as a letter may be both behind one and before the next."""
    for digit, letter in LEET * 2:
        c = F.regexp_replace(c, rf"([a-z]){digit}([a-z])", rf"$1{letter}$2")
    return c


def repair_digits_sql(expr: str) -> str:
    for digit, letter in LEET * 2:
        expr = f"regexp_replace({expr}, '([a-z]){digit}([a-z])', '\\1{letter}\\2', 'g')"
    return expr


def skeleton(c: Column) -> Column:
    """What is left of a word when spellings of one sound are made alike and all vowels but the first go."""
    once = lambda x: F.regexp_replace(x, r"([a-z])\1+", "$1")
    x = once(steps(F.lower(c), SKELETON))
    return once(F.concat(F.substring(x, 1, 1), F.regexp_replace(F.substring(x, 2, 1 << 30), "[aeiou]", "")))


def skeleton_sql(expr: str) -> str:
    def once(x: str) -> str:
        for ch in "abcdefghijklmnopqrstuvwxyz":
            x = f"regexp_replace({x}, '{ch}{{2,}}', '{ch}', 'g')"
        return x

    x = once(steps_sql(f"lower({expr})", SKELETON))
    return once(f"(substr({x}, 1, 1) || regexp_replace(substr({x}, 2), '[aeiou]', '', 'g'))")


def acronym(a: Column, b: Column) -> Column:
    """Whether one side's initials (two or more) are a token of the other, or all of it."""
    initials = lambda t: F.array_join(F.transform(F.filter(t, lambda w: ~w.rlike("^[0-9]+$")), lambda w: F.substring(w, 1, 1)), "")
    one = lambda x, y: (F.length(initials(x)) >= 2) & (F.array_contains(y, initials(x)) | (F.array_join(y, "") == initials(x)))
    return one(a, b) | one(b, a)


def bigrams(t: Column) -> Column:
    return F.zip_with(F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0))), F.slice(t, 2, F.greatest(F.size(t), F.lit(1))), lambda a, b: F.concat(a, F.lit("_"), b))


def name_tokens(t: Column) -> Column:
    """Words, ~skeletons, ^prefixes of long words, and adjacent pairs."""
    pre = F.transform(F.filter(t, lambda w: F.length(w) >= 6), lambda w: F.concat(F.lit("^"), F.substring(w, 1, 4)))
    return F.concat(t, F.transform(t, lambda w: F.concat(F.lit("~"), skeleton(w))), pre, bigrams(t))


def address_tokens(t: Column) -> Column:
    """Words, ^prefixes of long words that are no numbers, and adjacent pairs."""
    pre = F.transform(F.filter(t, lambda w: (F.length(w) >= 6) & ~w.rlike("^[0-9]+$")), lambda w: F.concat(F.lit("^"), F.substring(w, 1, 4)))
    return F.concat(t, pre, bigrams(t))


def house_locality(t: Column, nums: Column) -> Column:
    """n#word of the first two house numbers and the last eight distinct words of three letters or more."""
    words = F.array_distinct(F.filter(t, lambda w: ~w.rlike("^[0-9]+$") & (F.length(w) >= 3)))
    last = F.slice(words, F.greatest(F.size(words) - 7, F.lit(1)), 8)
    return F.flatten(F.transform(F.slice(nums, 1, 2), lambda n: F.transform(last, lambda w: F.concat(n, F.lit("#"), w))))


def generator_keys(t: Column) -> Column:
    """Keys that survive joining, order and initials: d_ all words joined, s_ sorted, and forms with initials; four characters or more."""
    w = F.filter(t, lambda x: ~x.rlike("^[0-9]+$"))
    ini = lambda x: F.substring(x, 1, 1)
    initials = F.array_join(F.transform(w, ini), "")
    last = F.coalesce(F.get(w, F.size(w) - 1), F.lit(""))
    rest = F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0)))
    keys = F.array(
        F.concat(F.lit("d_"), F.array_join(w, "")), F.concat(F.lit("s_"), F.array_join(F.array_sort(w), "")), F.concat(F.lit("i_"), F.substring(initials, 1, 2), last),
        F.concat(F.lit("l_"), ini(F.coalesce(F.get(w, F.lit(0)), F.lit(""))), last), F.concat(F.lit("r_"), F.array_join(rest, "")), F.concat(F.lit("f_"), F.array_join(F.slice(w, 1, 2), "")), F.concat(F.lit("a_"), initials),
    )
    return F.array_distinct(F.filter(keys, lambda k: F.length(k) >= 6))


def shared_keys(t: Column) -> Column:
    """Keys that a name shares with its website, handle, initials or another order: s_ sorted words; d_ all words joined, without the
    first, the first two, initials of the first two, of the first three, of all, of all but the last and the last; four characters or more."""
    w = F.filter(t, lambda x: ~x.rlike("^[0-9]+$"))
    initials = F.array_join(F.transform(w, lambda x: F.substring(x, 1, 1)), "")
    last = F.coalesce(F.get(w, F.size(w) - 1), F.lit(""))
    d = lambda *c: F.concat(F.lit("d_"), *c)
    keys = F.array(
        d(F.array_join(w, "")), F.concat(F.lit("s_"), F.array_join(F.array_sort(w), "_")), d(F.substring(initials, 1, 2)), d(F.left(initials, F.length(initials) - 1), last),
        d(F.array_join(F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), "")), d(F.array_join(F.slice(w, 1, 2), "")), d(F.substring(initials, 1, 3)), d(initials),
    )
    return F.array_distinct(F.filter(keys, lambda k: F.length(k) >= 4))


def char_ngrams(word_list: Column, n: int) -> Column:
    """Character n-grams of each word with a space on both sides."""
    one = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) + 2 - (n - 1), F.lit(1))), lambda i: F.concat(F.lit(" "), w, F.lit(" ")).substr(i, F.lit(n)))
    return F.filter(F.flatten(F.transform(word_list, one)), lambda g: F.length(g) == n)
