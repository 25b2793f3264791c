"""Names and texts: folds, similarity, scripts, romanisation, verbatim runs."""

from __future__ import annotations

import difflib
import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the area fold: sequences that full case folding expands, and single letters it unifies.
EXPANSIONS = {"i̇": "i", "ß": "ss", "ŉ": "ʼn", "և": "եւ", "ẚ": "aʾ", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "ﬓ": "մն", "ﬔ": "մե", "ﬕ": "մի", "ﬖ": "վն", "ﬗ": "մխ"}
VARIANTS = {
    "ſ": "s", "µ": "μ", "\u0345": "ι", "ϐ": "β", "ϑ": "θ", "ϕ": "φ", "ϖ": "π", "ϰ": "κ", "ϱ": "ρ", "ς": "σ", "ϴ": "θ", "ϵ": "ε",
    "ᲀ": "в", "ᲁ": "д", "ᲂ": "о", "ᲃ": "с", "ᲄ": "т", "ᲅ": "т", "ᲆ": "ъ", "ᲇ": "ѣ", "ᲈ": "ꙋ", "ẛ": "ṡ", "\u1fbe": "ι",
}
# First and last code points of scripts.
SCRIPTS = {
    "Latn": ((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F), (0x1E00, 0x1EFF)), "Grek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)), "Cyrl": ((0x400, 0x52F), (0x2DE0, 0x2DFF)), "Armn": ((0x530, 0x58F),), "Hebr": ((0x590, 0x5FF),),
    "Arab": ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF)), "Thaa": ((0x780, 0x7BF),), "Deva": ((0x900, 0x97F),), "Beng": ((0x980, 0x9FF),), "Guru": ((0xA00, 0xA7F),), "Gujr": ((0xA80, 0xAFF),), "Orya": ((0xB00, 0xB7F),),
    "Taml": ((0xB80, 0xBFF),), "Telu": ((0xC00, 0xC7F),), "Knda": ((0xC80, 0xCFF),), "Mlym": ((0xD00, 0xD7F),), "Sinh": ((0xD80, 0xDFF),), "Thai": ((0xE00, 0xE7F),), "Laoo": ((0xE80, 0xEFF),), "Tibt": ((0xF00, 0xFFF),),
    "Mymr": ((0x1000, 0x109F),), "Geor": ((0x10A0, 0x10FF), (0x1C90, 0x1CBF)), "Ethi": ((0x1200, 0x137F),), "Khmr": ((0x1780, 0x17FF),), "Hang": ((0x1100, 0x11FF), (0xAC00, 0xD7AF)), "Hira": ((0x3040, 0x309F),),
    "Kana": ((0x30A0, 0x30FF),), "Hani": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF)),
}
#: Scripts whose words stand without spaces.
UNSPACED = "぀-ヿ㐀-䶿一-鿿豈-﫿฀-๿"
SPACES = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def area_fold(name: Column) -> Column:
    """White space squeezed, lower case, expansions and variants unified; for names in composed form."""
    out = F.lower(F.trim(F.regexp_replace(F.translate(name, SPACES, " " * len(SPACES)), " +", " ")))
    for a, b in EXPANSIONS.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.translate(out, "".join(VARIANTS), "".join(VARIANTS.values()))


def area_fold_sql(name: str) -> str:
    out = f"lower(trim(regexp_replace(translate({name}, '{SPACES}', '{' ' * len(SPACES)}'), ' +', ' ', 'g')))"
    for a, b in EXPANSIONS.items():
        out = f"replace({out}, '{a}', '{b}')"
    return f"translate({out}, '{''.join(VARIANTS)}', '{''.join(VARIANTS.values())}')"


def match_confidence(needle: Column, other: Column) -> Column:
    """1 for equal, 0.6 for a prefix, 0.45 for a part, either way round; 0 otherwise and for empty names."""
    part = lambda test: test(needle, other) | test(other, needle)
    return F.when(F.coalesce(other, F.lit("")) == "", 0.0).when(other == needle, 1.0).when(part(F.startswith), 0.6).when(part(F.contains), 0.45).otherwise(0.0)


@F.pandas_udf(T.StringType())
def name_fold(names: pd.Series) -> pd.Series:
    """Case, accents, punctuation and spacing folded; scripts stay."""

    def one(name):
        if name is None:
            return None
        plain = (c for c in unicodedata.normalize("NFKD", name) if unicodedata.category(c) != "Mn")
        spaced = "".join(" " if unicodedata.category(c)[0] in "PSCZ" else c for c in plain)
        return " ".join(unicodedata.normalize("NFKC", spaced).casefold().split())

    return names.map(one)


@F.pandas_udf(T.DoubleType())
def fold_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-block ratio of two folded names, the same either way round; 0 if one is empty."""

    known: dict[tuple[str, str], float] = {}

    def one(x, y):
        if not x or not y:
            return 0.0
        if x == y:
            return 1.0
        pair = (x, y) if x < y else (y, x)
        if pair not in known:
            known[pair] = difflib.SequenceMatcher(None, *pair, autojunk=False).ratio()
        return known[pair]

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype=float)


#: Letters times letters up to which many pairs are matched at once; longer ones go to ``difflib`` one by one.
TABLE = 2048


def fold_ratios(names: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``fold_similarity`` of names[i] with names[j], many at once; names ascend and differ."""
    size = np.array([len(x) for x in names], np.int64)
    wide = int(size.max(initial=0)) + 1
    letters = np.array([*names, ""], f"U{wide}").view(np.uint32).reshape(-1, wide)
    known, at = np.unique(letters, return_inverse=True)  # the first is the filling
    at = at.reshape(letters.shape).astype(np.uint8 if len(known) < 255 else np.uint32)
    other = np.where(at == 0, np.iinfo(at.dtype).max, at)
    once = np.zeros(at.shape, bool)
    for c in range(wide - 1):
        once[:, c] = (at == at[:, c : c + 1]).sum(axis=1) == 1
    x, y = np.minimum(i, j), np.maximum(i, j)
    least = np.minimum(size[x], size[y])
    # A common beginning is the first block if none other can be longer: any other one lies on one side of a letter
    # of it that both names have once.
    begin = (at[x] != other[y]).argmax(axis=1)
    mark = once[x] & once[y] & (np.arange(wide) < begin[:, None])
    last = wide - 1 - mark[:, ::-1].argmax(axis=1)
    begin[~(mark.any(axis=1) & (least - last - 1 <= begin)) & (x != y)] = 0
    begin[x == y] = size[x][x == y]
    matched = begin.copy()
    flat, flat_other = at.ravel(), other.ravel()
    todo = [(np.arange(len(x)), begin, size[x], begin.copy(), size[y])]
    while todo:
        parts = [np.concatenate(c) for c in zip(*todo)]
        go = (parts[2] > parts[1]) & (parts[4] > parts[3])
        of, a, a_end, b, b_end = (c[go] for c in parts)
        todo = []
        shape = (a_end - a) * wide + b_end - b
        order = np.argsort(shape.astype(np.uint16) if wide < 256 else shape, kind="stable")
        cuts = np.flatnonzero(np.diff(shape[order], prepend=-1)).tolist()
        for s, e in zip(cuts, [*cuts[1:], len(order)]):
            m, n = divmod(int(shape[order[s]]), wide)
            if m * n > TABLE:
                for k in order[s:e].tolist():
                    match = difflib.SequenceMatcher(None, names[x[of[k]]][a[k] : a_end[k]], names[y[of[k]]][b[k] : b_end[k]], autojunk=False)
                    matched[of[k]] += sum(block.size for block in match.get_matching_blocks())
                continue
            step = max(1, (1 << 19) // n)
            for k in (order[q : min(q + step, e)] for q in range(s, e, step)):
                # Of the longest blocks the one that starts first in x, then in y.
                start, start_other = x[of[k]] * wide + a[k], y[of[k]] * wide + b[k]
                right = np.stack([flat_other[start_other + c] for c in range(n)])
                run, best, end, end_other = np.zeros((n + 1, len(k)), np.uint16), np.zeros(len(k), np.int64), np.zeros(len(k), np.int64), np.zeros(len(k), np.int64)
                place = (n - np.arange(n, dtype=np.int32))[:, None]
                for r in range(m):
                    run[1:] = (run[:-1] + 1) * (right == flat[start + r])
                    top = (run[1:].astype(np.int32) * (n + 1) + place).max(axis=0)
                    long = top // (n + 1)
                    more = np.flatnonzero(long > best)
                    best[more], end[more], end_other[more] = long[more], r + 1, n - top[more] % (n + 1) + 1
                hit = np.flatnonzero(best)
                k, best, end, end_other = k[hit], best[hit], end[hit], end_other[hit]
                matched[of[k]] += best
                todo.append((of[k], a[k], a[k] + end - best, b[k], b[k] + end_other - best))
                todo.append((of[k], a[k] + end, a_end[k], b[k] + end_other, b_end[k]))
    return np.where(least > 0, 2.0 * matched / np.maximum(size[x] + size[y], 1), 0.0)


def folds_alike(tau: float):
    """A function of two columns: whether ``fold_similarity`` reaches tau (above 0); bounds by letters come before the ratio."""

    @F.pandas_udf(T.BooleanType())
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        at, names = pd.factorize(pd.concat([a, b], ignore_index=True))
        i, j = at[: len(a)], at[len(a) :]
        out = (i >= 0) & (j >= 0)
        names = [*names, ""]
        size = np.array([len(x) for x in names])
        out &= (size[i] > 0) & (size[j] > 0)
        # Letters in common, told apart by 64 classes, are never fewer than those of matching blocks.
        letters = np.zeros((len(names), 64), np.int32)
        np.add.at(letters, (np.repeat(np.arange(len(names)), size), np.array([ord(c) % 64 for x in names for c in x], np.int64)), 1)
        some = np.flatnonzero(out)
        shared = np.zeros(len(some), np.int32)
        for c in np.flatnonzero(letters.any(axis=0)).tolist():
            shared += np.minimum(letters[i[some], c], letters[j[some], c])
        out[some] = 2.0 * shared / (size[i[some]] + size[j[some]]) >= tau
        low, high = np.minimum(i, j), np.maximum(i, j)
        some = np.flatnonzero(out)
        pairs, back = np.unique(low[some].astype(np.int64) << 32 | high[some], return_inverse=True)
        judged = []
        for x, y in zip((pairs >> 32).tolist(), (pairs & 0xFFFFFFFF).tolist()):
            x, y = sorted((names[x], names[y]))
            judged.append(x == y or difflib.SequenceMatcher(None, x, y, autojunk=False).ratio() >= tau)
        out[some] = np.array(judged, bool)[back]
        return pd.Series(out)

    return alike


def script_class(script: str) -> str:
    """A pattern for one letter of the script."""
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in SCRIPTS[script]) + "&&[\\p{L}]]"


def script_counts(text: Column, scripts=tuple(SCRIPTS)) -> Column:
    """Array of (script, n) of the scripts with letters in the text."""
    counts = [F.struct(F.lit(s).alias("script"), F.length(F.regexp_replace(text, "[^" + script_class(s)[1:-1].replace("&&[\\p{L}]", "") + "]|[^\\p{L}]", "")).alias("n")) for s in scripts]
    return F.filter(F.array(*counts), lambda c: c["n"] > 0)


def dominant_script(text: Column) -> Column:
    """The script with most letters, of equals the first by name; null without letters."""
    return F.get(F.array_sort(F.transform(script_counts(text), lambda c: F.struct((-c["n"]).alias("rank"), c["script"].alias("script")))), F.lit(0))["script"]


# Scripts that a language is written in; all other languages of this list are written in Latin.
EXPECTED_SCRIPTS = {
    "am": ("Ethi",), "ar": ("Arab",), "be": ("Cyrl",), "bg": ("Cyrl",), "bn": ("Beng",), "bo": ("Tibt",), "dv": ("Thaa",), "el": ("Grek",), "fa": ("Arab",),
    "gu": ("Gujr",), "he": ("Hebr",), "hi": ("Deva",), "hy": ("Armn",), "ja": ("Hani", "Hira", "Kana"), "ka": ("Geor",), "km": ("Khmr",), "kn": ("Knda",), "ko": ("Hang",),
    "lo": ("Laoo",), "mk": ("Cyrl",), "ml": ("Mlym",), "mr": ("Deva",), "my": ("Mymr",), "ne": ("Deva",), "or": ("Orya",), "pa": ("Guru",), "ru": ("Cyrl",), "si": ("Sinh",),
    "sr": ("Cyrl", "Latn"), "ta": ("Taml",), "te": ("Telu",), "th": ("Thai",), "ti": ("Ethi",), "uk": ("Cyrl",), "ur": ("Arab",), "yi": ("Hebr",), "zh": ("Hani",),
} | {x: ("Latn",) for x in "af az ca cs cy da de en es et eu fi fr ga gl hr hu id is it lt lv ms mt nl no pl pt ro sk sl sq sv sw tl tr uz vi".split()}


def expected_scripts(tag: Column) -> Column:
    """Scripts that a value of the language tag may have: that of its subtag, else the language's; empty for unknown languages."""
    own = F.filter(F.slice(F.split(tag, "-"), 2, 9), lambda x: x.rlike("^[A-Za-z]{4}$"))
    known = F.create_map(*(x for k, v in EXPECTED_SCRIPTS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    usual = F.coalesce(F.try_element_at(known, F.lower(F.get(F.split(tag, "-"), F.lit(0)))), F.expr("cast(array() as array<string>)"))
    return F.when(F.size(own) > 0, F.array(F.initcap(F.get(own, F.size(own) - 1)))).otherwise(usual)


def script_check(text: Column, tag: Column) -> Column:
    """match, mismatch, unknown (no script is expected) or empty (no letters).

    The declared script must be there, and no other script but Latin may have as many letters.
    """
    counts, expected = script_counts(text), expected_scripts(tag)
    most = lambda keep: F.coalesce(F.array_max(F.transform(F.filter(counts, keep), lambda c: c["n"])), F.lit(0))
    declared = F.aggregate(F.filter(counts, lambda c: F.array_contains(expected, c["script"])), F.lit(0), lambda a, c: a + c["n"])
    rival = most(lambda c: ~F.array_contains(expected, c["script"]) & (c["script"] != "Latn"))
    return F.when(F.size(counts) == 0, "empty").when(F.size(expected) == 0, "unknown").when((declared == 0) | (rival >= declared), "mismatch").otherwise("match")


def word_count(text: Column) -> Column:
    """Runs without white space; in scripts without spaces each character."""
    return F.regexp_count(text, F.lit(f"[{UNSPACED}]|[^\\s{UNSPACED}]+"))


def word_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[\\p{L}\\p{N}_]+"), F.lit(0))


def runs(tokens: Column, width: int) -> Column:
    """A 64-bit hash of each run of ``width`` consecutive tokens: joins on runs move these, not the words."""
    starts = F.sequence(F.lit(1), F.size(tokens) - width + 1)
    return F.when(F.size(tokens) >= width, F.transform(starts, lambda i: F.xxhash64(F.slice(tokens, i, width)))).otherwise(F.expr("cast(array() as array<bigint>)"))


def shared_runs(left: DataFrame, right: DataFrame, a: str, b: str, width: int) -> DataFrame:
    """(a, b, n_runs): distinct runs of ``width`` tokens (column t) that rows of both share.

    Hashes of the few rows' runs (``right``) find candidates; the words themselves decide.
    """
    each = lambda df, key: df.select(key, "t", F.posexplode(runs(F.col("t"), width)).alias("i", "h"))
    words = lambda t: F.slice(t, F.col("i") + 1, width)
    wanted = each(right, b).select(b, "h", F.array_join(words(F.col("t")), " ").alias("words")).distinct()
    found = each(left, a).join(wanted.select("h").distinct(), "h", "left_semi").select(a, "h", F.array_join(words(F.col("t")), " ").alias("words")).distinct()
    return found.join(wanted, ["h", "words"]).groupBy(a, b).agg(F.count("*").alias("n_runs"))


# Fixed values of the Greek romanisation, after ELOT 743: letters, pairs of consonants (some by their place), pairs of vowels.
LETTERS = {
    "α": "a", "β": "v", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "i", "θ": "th", "ι": "i", "κ": "k", "λ": "l", "μ": "m",
    "ν": "n", "ξ": "x", "ο": "o", "π": "p", "ρ": "r", "σ": "s", "τ": "t", "υ": "y", "φ": "f", "χ": "ch", "ψ": "ps", "ω": "o",
}
CONSONANTS = {"γγ": "ng", "γξ": "nx", "γχ": "nch", "γκ": "ng", "μπ": "mp", "ντ": "nt"}
FIRST = {"γκ": "g", "μπ": "b", "ντ": "d"}
VOWELS = {"αι": "ai", "ει": "ei", "οι": "oi", "ου": "ou", "υι": "yi"}
BEFORE_VOICED = {"αυ": "av", "ευ": "ev", "ηυ": "iv"}
ELSEWHERE = {"αυ": "af", "ευ": "ef", "ηυ": "if"}
VOICED = "αβγδεζηιλμνορυω"
GREEK_VARIANTS = {"ϐ": "β", "ϑ": "θ", "ϰ": "κ", "ϱ": "ρ", "ς": "σ", "ϲ": "σ"}
ACCENTS = "\u0300\u0301\u0302\u0303\u0304\u0306\u0313\u0314\u0342\u0345"
_MARK = "[\u0300-\u036f]"
_GREEK = "".join([*LETTERS, *GREEK_VARIANTS]) + "".join([*LETTERS, "ϲ"]).upper()
_GREEK_RUN = re.compile(f"(?:[{_GREEK}]{_MARK}*)+")


def _rules() -> tuple[re.Pattern, list[str]]:
    """One pattern, a group for each rule, the longest and most particular first; and what each gives."""
    both = f"{{0}}{_MARK}*{{1}}{_MARK}*"
    start = f"(?<![{''.join(LETTERS)}\u0300-\u036f])"
    # A pair of vowels is one sound unless the first has an accent or the second a diaeresis.
    one_sound = f"{{0}}(?!{_MARK}*[{ACCENTS}]){_MARK}*{{1}}(?!{_MARK}*\u0308){_MARK}*"
    rules = [(start + both.format(*pair), latin) for pair, latin in FIRST.items()]
    rules += [(both.format(*pair), latin) for pair, latin in CONSONANTS.items()]
    rules += [(one_sound.format(*pair) + f"(?=[{VOICED}])", latin) for pair, latin in BEFORE_VOICED.items()]
    rules += [(one_sound.format(*pair), latin) for pair, latin in (ELSEWHERE | VOWELS).items()]
    rules += [(f"{letter}{_MARK}*", latin) for letter, latin in LETTERS.items()]
    return re.compile("|".join(f"({pattern})" for pattern, _ in rules)), [latin for _, latin in rules]


_RULES, _LATIN = _rules()


def _latin(run: re.Match) -> str:
    """A run of decomposed Greek letters; its case is that of the run."""
    bare = re.sub(_MARK, "", run[0])
    low = run[0].lower().translate(str.maketrans(GREEK_VARIANTS))
    out = _RULES.sub(lambda m: _LATIN[m.lastindex - 1], low)
    return out.upper() if bare.isupper() else out[:1].upper() + out[1:] if bare[0].isupper() else out


@F.pandas_udf(T.StringType())
def romanise_greek(names: pd.Series) -> pd.Series:
    """Greek letters in Latin ones for display; all else stays."""
    return names.map(lambda n: None if n is None else unicodedata.normalize("NFC", _GREEK_RUN.sub(_latin, unicodedata.normalize("NFD", n))))
