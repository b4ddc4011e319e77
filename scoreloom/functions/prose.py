"""Python forms of the text rules for kernels: prose, cell and token normalisers, and fuzzy search.

A normaliser is a list of steps that run in order; most steps are a pattern and what it becomes.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Sequence
from html import unescape

import numpy as np

# fixed values: signs that count as one another, and the markup that normalisers know
SINGLE_QUOTES = "‘’‚‛`´ʼʹ＇′‵ʻˊˋ"
DOUBLE_QUOTES = "“”„‟〝〞＂″‶ˮ"
FULL_WIDTH = {"，": ",", "．": ".", "：": ":", "；": ";", "！": "!", "？": "?", "（": "(", "）": ")", "、": ",", "。": "."}
BULLETS, CROSSES = "●○◦∙⦁·", "⮾ⓧ⨂"
DASHES = "–—‑‒−"
SUPERSCRIPTS, SUPERSCRIPTS_PLAIN = "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾ⁿⁱ", "0123456789+-=()ni"
SUBSCRIPTS, SUBSCRIPTS_PLAIN = "₀₁₂₃₄₅₆₇₈₉₊₋₌₍₎ₐₑₕᵢⱼₖₗₘₙₒₚᵣₛₜᵤᵥₓ", "0123456789+-=()aehijklmnoprstuvx"
CJK_WORDS = (("一", "鿿"), ("㐀", "䶿"), ("豈", "﫿"), ("぀", "ゟ"), ("゠", "ヿ"), ("가", "힯"))
MARKS_STAY = (*CJK_WORDS, ("ᄀ", "ᇿ"), ("஀", "௿"), ("ಀ", "೿"))
AUTOLINK = r"(?i)<((?:https?://|mailto:)[^>\s]+|[^>@\s]+@[^>@\s]+\.[^>@\s]+)>"

QUOTES = str.maketrans({**dict.fromkeys(SINGLE_QUOTES, "'"), **dict.fromkeys(DOUBLE_QUOTES, '"'), **FULL_WIDTH})
SYMBOLS = str.maketrans({**dict.fromkeys(BULLETS, "•"), **dict.fromkeys(CROSSES, "⊗")})
TO_HYPHEN = str.maketrans(dict.fromkeys(DASHES, "-"))
SCRIPTS = str.maketrans(SUPERSCRIPTS + SUBSCRIPTS, SUPERSCRIPTS_PLAIN + SUBSCRIPTS_PLAIN)

Step = Callable[[str], str]


def sub(pattern: str, by: str = "") -> Step:
    return functools.partial(re.compile(pattern).sub, by)


def swap(table: dict) -> Step:
    return lambda s: s.translate(table)


def steps(*all_: Step) -> Step:
    return lambda s: functools.reduce(lambda x, f: f(x), all_, s)


def _in(ch: str, ranges: Iterable[tuple[str, str]]) -> bool:
    return any(a <= ch <= b for a, b in ranges)


def drop_accents(s: str, keep: tuple = MARKS_STAY) -> str:
    """Without combining marks, but those after a letter of ``keep``."""
    if s.isascii():
        return s
    out: list[str] = []
    for ch in unicodedata.normalize("NFD", s):
        if unicodedata.category(ch) != "Mn" or out and _in(out[-1], keep):
            out.append(ch)
    return unicodedata.normalize("NFC", "".join(out))


def entities(s: str) -> str:
    """Entities decoded, twice at most; a pass that would make more ampersands isn't taken."""
    for _ in range(2):
        after = unescape(s)
        if after == s or after.count("&") > s.count("&"):
            break
        s = after
    return s


_dashes_and_dots = str.maketrans({**dict.fromkeys(DASHES, "-"), "＿": "_", "…": "...", "µ": "μ"})
_tags_gone = sub(r"</?(?:ins|u|mark)>|~~|\$\$")

#: What prose is compared in: no markup, accents or case.
_prose = steps(
    sub(AUTOLINK, r"\1"), sub(r"<br\s*/?>", " "), swap(QUOTES), sub(r"\s+", " "),
    sub(r"\*\*(.*?)\*\*", r"\1"), sub(r"__(.*?)__", r"\1"), sub(r"</?b>"), sub(r"</?i>"), sub(r"\*(.*?)\*", r"\1"), sub(r"_(.*?)_", r"\1"),
    lambda s: s.replace("_", " "), drop_accents, swap(_dashes_and_dots), _tags_gone, swap(SYMBOLS),
    sub(r"(?i)</?(?:s|del|strike)>"), sub(r"(?i)</?span\b[^>]*>"), sub(r"(?i)<sup[^>]*>.*?</sup>"), sub(r"(?i)<sub[^>]*>.*?</sub>"),
    sub("[¹²³⁰⁴-⁹]+"), sub("[₀-₉]+"), sub(r"-{2,}", "-"), sub(r"\.{2,}\s*$"), str.lower,
)
_styled = steps(
    sub(AUTOLINK, r"\1"), sub(r"<br/?>", " "), sub(r"(?i)</?span\b[^>]*>"), swap(QUOTES), sub(r"\s+", " "),
    functools.partial(drop_accents, keep=()), swap(_dashes_and_dots), swap(SYMBOLS), sub(r"-{2,}", "-"), str.strip,
)
_cell = steps(
    sub(r"(?i)<sup[^>]*>(.*?)</sup>", r"\1"), sub(r"(?i)<sub[^>]*>(.*?)</sub>", r"\1"), swap(SCRIPTS),
    sub(r"(?i)</?(?:b|i|u|s|em|strong|del|strike|mark|ins)>"), sub(r"(?i)</?span\b[^>]*>"),
    sub(r"\*\*(.*?)\*\*", r"\1"), sub(r"__(.*?)__", r"\1"), sub(r"(?<!\*)\*(?!\*)(.*?)(?<!\*)\*(?!\*)", r"\1"), sub(r"(?<!_)_(?!_)(.*?)(?<!_)_(?!_)", r"\1"), sub(r"~~(.*?)~~", r"\1"),
    swap(SYMBOLS), swap(QUOTES), swap(TO_HYPHEN), sub(r"\.{2,}\s*$"), sub(r"\s+", " "), str.strip, sub(r"^[\s\-]+$", "-"),
)


def prose(s: str | None) -> str:
    return _prose(s) if s else ""


def styled(s: str | None) -> str:
    """Lightly normalised: formatting and case stay."""
    return _styled(s) if s else ""


def cell(s: str | None) -> str:
    """A table cell: formatting, symbols, quotes, dashes, dot leaders and white space; case and accents stay."""
    return _cell(s) if s else ""


# --- words and sentences ---------------------------------------------------------------------------------------------------

SHORTEST_WORD, SHORTEST_SENTENCE = 2, 7
_WORD = re.compile(r"\w+")
_MANY_DOTS = sub(r"\.(?:\s*\.)+", " ")
_TAGS = sub(r"</?[^>]+>", " ")
_LEADING = sub(r"^(?:\s*(?:#{1,6}\s+|>\s+|[*+-]\s+|\d+[.)]\s+))+")
_IMAGES = sub(r"!\[[^\]]*\]\([^)]*\)", " ")
_ENDS = sub(r"^[^\w]+|[^\w]+$")
_LINKS = sub(AUTOLINK, r"\1")
_SPACES = sub(r"\s+", " ")
_SENTENCE_END = re.compile("\n+|(?<!\\d)\\.(?!\\d)|[!?]+|[。、，！？；…‥⋯]+")
_CJK_RUN = re.compile("[" + "".join(f"{a}-{b}" for a, b in CJK_WORDS) + "]+")


def is_cjk(s: str) -> bool:
    return bool(_CJK_RUN.search(s))


def words(s: str, least: int = SHORTEST_WORD) -> list[str]:
    """Runs of letters, digits and underscores; those of Chinese, Japanese or Korean signs stand alone, at any length."""
    out = []
    for run in _WORD.findall(s):
        if not is_cjk(run):
            out += [run] if len(run) >= least else []
            continue
        at = 0
        for m in _CJK_RUN.finditer(run):
            out += [x for x in (run[at : m.start()],) if len(x) >= least]
            out.append(m.group())
            at = m.end()
        out += [x for x in (run[at:],) if len(x) >= least and x]
    return out


def occurrences(word: str, s: str) -> int:
    """How often a word stands in a text; within other words too for Chinese, Japanese and Korean."""
    return s.count(word) if is_cjk(word) else len(re.findall(rf"(?<!\w){re.escape(word)}(?!\w)", s))


def sentence(s: str) -> str:
    """A sentence as bags hold it; empty if it is shorter than SHORTEST_SENTENCE."""
    s = entities(_MANY_DOTS(prose(s).strip().strip(".")))
    s = _SPACES(_ENDS(_LEADING(_TAGS(_LINKS(s))).strip()).strip())
    return s if len(s) >= SHORTEST_SENTENCE else ""


def chunks(s: str) -> list[str]:
    """Parts between sentence ends; one that makes no sentence joins the next, the last the one before it."""
    out, open_ = [], ""
    for part in filter(None, map(str.strip, _SENTENCE_END.split(_MANY_DOTS(s)))):
        whole = f"{open_} {part}" if open_ else part
        if sentence(whole):
            out.append(whole)
            open_ = ""
        else:
            open_ = whole
    if open_:
        out[-1:] = [f"{out[-1]} {open_}" if out else open_]
    return out


# --- formulas, code and tables within a page --------------------------------------------------------------------------------

_BLOCK_FORMULA = re.compile(r"\$\$((?:[^$]|\$[^$])+)\$\$", re.DOTALL)
_INLINE_FORMULA = re.compile(r"\$(?!\d)((?:[^$\\\n]|\\.)+)\$")
_FENCE = re.compile(r"^`{3,}(?:mermaid|description)[^\S\n]*\n.*?^`{3,}[^\S\n]*$", re.MULTILINE | re.DOTALL)


def formula_signs(body: str) -> str:
    """What is left of a formula in prose: letters, digits and operators, or a placeholder."""
    body = re.sub(r"\\(?:[a-zA-Z]+|[^a-zA-Z])", " ", body)
    return re.sub(r"[^0-9a-zA-Z+\-*/=<>().,]", "", body) or "LATEX"


def without_formulas(s: str) -> str:
    s = _BLOCK_FORMULA.sub(lambda m: f" {formula_signs(m[1])} ", s)
    return _INLINE_FORMULA.sub(lambda m: formula_signs(m[1]), s)


def without_fences(s: str) -> str:
    """Without code blocks that describe pictures."""
    return _FENCE.sub(" ", s)


def without_tables(s: str) -> str:
    """Without HTML tables; one that isn't closed takes all that follows."""
    while True:
        s, n = re.subn(r"(?is)<table\b[^>]*>.*?</table>", " ", s)
        if not n:
            break
    return re.sub(r"(?is)<table\b.*", " ", s)


# --- likeness ------------------------------------------------------------------------------------------------------------------


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for ch in b:
        u = v & where.get(ch, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def ratio(a: str, b: str) -> float:
    """2 * common subsequence / all signs; two empty texts are alike."""
    return 2 * common_subsequence(a, b) / (len(a) + len(b)) if a or b else 1.0


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter text with a part of the longer one that is no longer than it; an empty one is like an empty one alone."""
    short, long = sorted((a, b), key=len)
    if not short:
        return float(not long)
    if short in long:
        return 1.0
    n, best = len(short), 0.0
    signs = set(short)
    windows = [long[i : i + n] for i in range(len(long) - n + 1) if long[i + n - 1] in signs or long[i] in signs]
    windows += [long[:i] for i in range(1, n)] + [long[len(long) - i :] for i in range(1, n)]
    have, need = Counter(short), len(short)
    for w in windows:
        most = 2 * sum((have & Counter(w)).values()) / (need + len(w))
        if most > best:
            best = max(best, ratio(short, w))
    return best


def near_ends(pattern: str, s: str, most: int) -> list[tuple[int, int]]:
    """(end, edit distance) of the places where a part of ``s`` ends that is within ``most`` edits of the pattern: the best end of each run of ends."""
    p = np.frombuffer(pattern.encode("utf-32-le"), np.uint32)
    n = np.arange(len(p) + 1)
    d, out = n.copy(), []
    for j, ch in enumerate(np.frombuffer(s.encode("utf-32-le"), np.uint32), 1):
        e = np.empty_like(d)
        e[0] = 0
        e[1:] = np.minimum(d[:-1] + (p != ch), d[1:] + 1)
        d = np.minimum.accumulate(e - n) + n
        if d[-1] <= most:
            out.append((j, int(d[-1])))
    best: list[tuple[int, int]] = []
    for end, cost in out:
        if best and end - best[-1][0] <= len(p) // 2 + most:
            if cost < best[-1][1]:
                best[-1] = (end, cost)
        else:
            best.append((end, cost))
    return best


def near_matches(pattern: str, s: str, most: int) -> list[int]:
    """Where parts begin that are within ``most`` edits of the pattern; one place for parts that overlap by half or more."""
    if not most:
        out, at = [], s.find(pattern)
        while at >= 0:
            out.append(at)
            at = s.find(pattern, at + max(1, len(pattern)))
        return out
    return sorted(len(s) - end for end, _ in near_ends(pattern[::-1], s[::-1], most))


def jaro_winkler(a: str, b: str, weight: float = 0.1) -> float:
    """Jaro-Winkler similarity (Winkler 1990), with the bonus for up to four first signs."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used, mine = [False] * len(b), []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == ch:
                used[j] = True
                mine.append(ch)
                break
    if not mine:
        return 0.0
    theirs = [ch for ch, u in zip(b, used, strict=True) if u]
    m, moved = len(mine), sum(x != y for x, y in zip(mine, theirs, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    head = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        head += 1
    return jaro + head * weight * (1 - jaro) if jaro > 0.7 else jaro


def edit_distance(a: Sequence, b: Sequence) -> int:
    """Levenshtein distance."""
    if len(a) < len(b):
        a, b = b, a
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]
