"""Training labels without annotators: labelling rules of high precision over a bounded sample of the texts.

The rules only teach the field model; they never label the corpus.  They lean on evidence that most texts lack (an
address beside a name, a word that announces a number), so that the model has to carry what it learns about words,
shapes and neighbours over to the texts without such evidence.  No rule knows a sentence: what announces a number are
words for phones and papers, and a shape that they announce in a good part of its occurrences is of that kind in the others
too.  Where a rule cannot tell, it abstains instead of saying O: a number whose shape is announced now and then, and an
initial with a family name without a word that leads to a person.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np

from annalist.llm.pii.crf import tokenize
from annalist.llm.pii.tokens import BA, BP, EMAIL, IA, ID, ID_WORDS, IP, PARTICLES, PHONE, PHONE_WORDS, STREET_ENDS, STREETS, email_parts, shared_mailbox

_NAME = re.compile(r"^\W*([^\W\d_]{2,})((?: [a-z]{2,3}){0,2}) ([^\W\d_][\w'’-]+)\s*<([^<>@\s]+)@", re.UNICODE)
COMPASS = frozenset("N S E W NE NW SE SW".split())
_PLAIN = str.maketrans("áàâäãåéèêëíìîïóòôöõøúùûüñçğşıłßýÿ", "aaaaaaeeeeiiiioooooouuuuncgsilsyy")
ID_SHAPES = re.compile(
    r"\d{3}[ -]\d{2}[ -]\d{4}|\d{2} \d{3} \d{3} \d{3}|[A-Z]{2} ?\d\d ?\d\d ?\d\d ?[A-D]|\d{7,8}[ -]?[A-Z]|[A-Z]\d{7,8}|[A-Z]\d\d[A-Z]\d\d[A-Z]\d\d|[A-Z]{2,5}\d{6,9}[A-Z0-9]{3,8}|\d{11}"
)
PHONE_SHAPES = re.compile(r"(?:\+|00)?[\d(][\d ()./-]{7,22}\d")


def plain(x: str) -> str:
    return x.lower().translate(_PLAIN)


def given_name(author: str) -> str | None:
    """The first word of an author whose address spells that word."""
    m = _NAME.match(author)
    return m[1].lower() if m and plain(m[1]) in re.split(r"[^a-z]+", plain(m[4])) else None


def given_names(authors: list[str], people: list[str]) -> frozenset[str]:
    """Given names: first words of entity names of persons, and of authors whose address spells that word."""
    seen: Counter[str] = Counter()
    for a in authors:
        if w := given_name(a):
            seen[w] += 1
    for p in people:
        w = p.split()
        if len(w) >= 2 and re.fullmatch(r"[^\W\d_]{2,}", w[0]):
            seen[w[0].lower()] += 1
    return frozenset(w for w, n in seen.items() if n >= 2)


def _word(t: str) -> bool:
    return t[:1].isalpha() and not re.search(r"\d", t)


def _family(t: str) -> bool:
    return _word(t) and len(t) > 2 and t.lower() not in PARTICLES


#: Labels that say little: the token may be a phone number or none, part of a person's name or not, an identity number or none.
MAYBE_PHONE, MAYBE_NAME, MAYBE_ID = -1, -2, -3
#: From these shares of announced occurrences on, the others of a shape are of that kind, or left open.
EVIDENT, POSSIBLE = 0.25, 0.05
_STOPS, _SHORT = frozenset(".!?;"), frozenset("no nr num tel ph sec soc mob mr dr".split())
_LEAD = frozenset("to by from with cc dr for and -- = . , : ; ( [".split())


def number_shape(t: str) -> str:
    return re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"\d", "9", t)))


def announced(tokens: list[str], low: list[str], i: int) -> tuple[bool, bool]:
    """Whether a token of digits is announced as an identity number, and whether as a phone number, by one of the five
    tokens before it in its sentence."""
    t, k = tokens[i].strip(), i
    while k > max(0, i - 5) and "\n" not in tokens[k][: len(tokens[k]) - len(tokens[k].lstrip())] and not (low[k - 1] in _STOPS and not (low[k - 1] == "." and k > 1 and low[k - 2] in _SHORT)):
        k -= 1
    before = set(low[k:i])
    papers = bool(before & ID_WORDS)
    return papers and ID_SHAPES.fullmatch(t) is not None, not papers and PHONE_SHAPES.fullmatch(t) is not None and 8 <= sum(c.isdigit() for c in t) <= 15 and (bool(before & PHONE_WORDS) or t[0] == "+")


def evident_shapes(texts: list[str]) -> dict[str, int]:
    """Label of the unannounced occurrences of each shape of numbers that is announced now and then."""
    papers: Counter[str] = Counter()
    phones: Counter[str] = Counter()
    all_: Counter[str] = Counter()
    for x in texts:
        tokens = tokenize([x])[0]
        t = [a.strip() for a in tokens]
        low = [a.lower() for a in t]
        for i, a in enumerate(t):
            if any(c.isdigit() for c in a) and not email_parts(a):
                s = number_shape(a)
                all_[s] += 1
                is_id, is_phone = announced(tokens, low, i)
                papers[s] += is_id
                phones[s] += is_phone
    out = {}
    for s, n in all_.items():
        most = max(papers[s], phones[s])
        if most >= POSSIBLE * n:
            is_id = papers[s] == most
            out[s] = (ID if is_id else PHONE) if most >= EVIDENT * n else MAYBE_ID if is_id else MAYBE_PHONE
    return out


def label(text: str, given: frozenset[str], evident: dict[str, int] | None = None) -> np.ndarray:
    """Labels of the tokens of one text by the rules; negative ones where they abstain."""
    tokens, _, _ = tokenize([text])
    t = [x.strip() for x in tokens]
    low = [x.lower() for x in t]
    y = np.zeros(len(t), dtype=np.int8)
    n = len(t)

    def take(i: int, j: int, b: int, inner: int) -> None:
        if not y[i:j].any():
            y[i] = b
            y[i + 1 : j] = inner

    for i in range(n):
        if email_parts(t[i]) and re.search(r"[A-Za-z]{2}", email_parts(t[i])[1]) and not shared_mailbox(t[i]) and (i + 1 >= n or t[i + 1] != ":" or tokens[i + 1] != ":" or not re.match(r"\S", text[len("".join(tokens[: i + 2])) :][:1] or " ")):
            y[i] = EMAIL
    for i in range(n):
        if not re.search(r"\d", t[i]) or y[i]:
            continue
        is_id, is_phone = announced(tokens, low, i)
        if is_id or is_phone:
            y[i] = ID if is_id else PHONE
        elif evident:
            y[i] = evident.get(number_shape(t[i]), 0)
    # addresses
    for i in range(n):
        house = re.fullmatch(r"\d{1,4}[A-Za-z]?", t[i])
        if not house:
            continue
        j = i + 1
        words = []
        # A point may stand behind a compass point.
        while j < n and len(words) < 5 and (_word(t[j]) or (t[j] == "." and t[j - 1] in COMPASS)):
            if t[j] != ".":
                words.append(low[j])
            j += 1
            if words[-1] in STREETS and words[0] not in ("rue", "calle", "via", "avenida"):
                break
        if words and words[-1] in STREETS and len(words) >= 2 and words[0] not in ("rue", "calle"):
            if j < n and t[j] == "." and words[-1] in ("st", "ave", "rd", "blvd", "ln", "dr", "ct", "pl", "sq"):
                j += 1
            take(i, j, BA, IA)
        elif words and words[0] == "rue":
            k = i + 1
            while k < n and _word(t[k]) and (low[k] in ("rue", "des", "de", "du", "la", "le") or t[k][0].isupper() or low[k] not in ("in", "was")):
                k += 1
                if k - i > 5 or (k < n and low[k] in ("in", "was")):
                    break
            take(i, k, BA, IA)
        if i and low[i - 1].endswith(STREET_ENDS) and len(t[i - 1]) > 6:
            take(i - 1, i + 1, BA, IA)
        for back in range(2, 6):
            if i - back >= 0 and low[i - back] in ("calle", "avenida", "plaza", "paseo") and all(_word(t[k]) for k in range(i - back, i)):
                take(i - back, i + 1, BA, IA)
                break
    # persons: a given name or an initial beside a family name
    i = 0
    while i < n:
        if low[i] in given and not y[i]:
            j = i + 1
            while j < n and low[j] in PARTICLES and j - i < 4:
                j += 1
            alike = j < n and (t[j][:1].isupper() == t[i][:1].isupper())
            if j < n and _family(t[j]) and alike and not y[j] and low[j] not in given and tokens[j][:1].isspace():
                take(i, j + 1, BP, IP)
                i = j + 1
                continue
            if i >= 2 and t[i - 1] == "," and _family(t[i - 2]) and t[i - 2][:1].isupper() == t[i][:1].isupper() and not y[i - 2]:
                k = i - 2
                while k > 0 and low[k - 1] in PARTICLES:
                    k -= 1
                take(k, i + 1, BP, IP)
        if len(t[i]) == 1 and t[i].isupper() and i + 2 < n and t[i + 1] == "." and not tokens[i + 1][:1].isspace() and not y[i]:
            j = i + 2
            while j < n and low[j] in PARTICLES:
                j += 1
            if j < n and _family(t[j]) and t[j][:1].isupper() and low[j] not in STREETS and not (j + 1 < n and low[j + 1] in STREETS):
                if i == 0 or low[i - 1] in _LEAD:
                    take(i, j + 1, BP, IP)
                else:
                    take(i, j + 1, MAYBE_NAME, MAYBE_NAME)
        i += 1
    return y
