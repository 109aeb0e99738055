"""Tokens of the field model and what is known about a token by itself.

A text is tiled by tokens, each with the white space before it.  Runs that could be one item as a whole (e-mail
addresses however spelt, groups of digits, codes of letters and digits) are one token, so that the model labels them
at once; whether they are an item is for the model to say.
"""

from __future__ import annotations

import re

LABELS = ("O", "email", "phone", "id_number", "B-person", "I-person", "B-address", "I-address")
O, EMAIL, PHONE, ID, BP, IP, BA, IA = range(8)

_AT = r"(?:@|%40|\s?\[at\]\s?|\s?\(at\)\s?|\sAT\s|\s?\{at\}\s?)"
_DOT = r"(?:\.|\s?\[dot\]\s?|\s?\(dot\)\s?|\sDOT\s|\s?\{dot\}\s?)"
_LOCAL = r"[\w.+'’-]{1,80}+"
TOKEN = re.compile(
    r"\s*+(?:"
    rf"(?<![\w.+'’-]){_LOCAL}{_AT}[\w-]{{1,63}}+(?:{_DOT}[A-Za-z0-9][\w-]{{0,62}}+){{1,126}}"
    # codes of letters and digits, single groups joined by spaces where the letters stand at the ends
    r"|(?<!\w)[A-Z]{2} ?\d\d ?\d\d ?\d\d ?[A-D](?!\w)|(?<!\w)\d{7,8}[ -]?[A-Z](?!\w)"
    # a number of groups of digits, each joined by one or two signs
    r"|\+?\(?\d++(?:(?:\) ?|\)\(| ?\(|[ ./-])\(?\d++){1,8}\)?(?![\w:])"
    r"|(?<!\w)\+\d{7,15}+(?!\w)"
    r"|(?<!\w)[A-Za-z]{0,5}\d[A-Za-z0-9]*+"
    r"|[^\W\d_]++(?:['’-](?!s\b)[^\W\d_]++)*+"
    r"|['’]s\b"
    r"|[^\s]"
    r")|\s++",
)
# Particles of family names.
PARTICLES = frozenset("von van der den de la del di da du le ten ter zu zum al el bin ibn".split())
# Titles before names.
TITLES = frozenset("dr mr mrs ms miss prof sir frau herr mme m sr sra señor señora monsieur madame don doña ing dipl".split())
# Words that name kinds of streets, with usual short forms.
STREETS = frozenset(
    "street st road rd avenue ave lane ln close terrace crescent mews boulevard blvd drive way court ct place pl square sq row walk hill gardens grove parade quay rue allée impasse chemin quai calle avenida plaza paseo camino via viale piazza corso".split()
)
STREET_ENDS = ("straße", "strasse", "weg", "gasse", "allee", "platz", "damm", "ufer", "ring", "straat", "laan", "gade", "gatan")
# Articles and prepositions inside the names of streets.
ARTICLES = frozenset("de des du la le les del los las el della dei".split())
# Words that lead in identity numbers.
ID_WORDS = frozenset("ssn ssn: soc sec social security national insurance nino ni nin tin tax passport licence license driving ausweis ausweis-nr identity dni nif nie card personalausweis steuer-id id".split())
# Those of them that are common words elsewhere.
PLAIN_ID_WORDS = frozenset("security insurance driving identity national social card id sec soc".split())
PHONE_WORDS = frozenset("phone tel telephone call mobile cell ph fax callback bridge handy telefon teléfono téléphone".split())
# Words of mailboxes that belong to teams, lists and tools, not to persons.
SHARED_LOCAL = frozenset("noreply no-reply donotreply oncall on-call git bot bots admin root postmaster support help info alerts alert team list lists builds build ci release releases security abuse notifications notify ops dev jenkins webmaster hello contact service mailer daemon".split())
SHARED_HOST = frozenset("lists list ci bots bot noreply code git groups alerts build builds tools jenkins github gitlab".split())
_EMAIL = re.compile(rf"({_LOCAL}){_AT}(.+)", re.DOTALL)
_SPLIT = re.compile(r"[^a-z0-9]+")


def shape(t: str) -> str:
    s = re.sub(r"[A-ZÀ-ÖØ-ÞŞĞİŁŚ]", "X", t[:40])
    s = re.sub(r"[^\W\d_X]", "x", s)
    s = re.sub(r"\d", "9", s)
    return re.sub(r"(.)\1{3,}", r"\1\1\1+", s)


def email_parts(t: str) -> tuple[str, str] | None:
    m = _EMAIL.fullmatch(t.strip())
    return (m[1], m[2]) if m else None


def normal_address(t: str) -> str:
    """The address in lower case with plain signs, empty where ``t`` is none."""
    p = email_parts(t)
    return f"{p[0]}@{re.sub(_DOT, '.', p[1])}".lower() if p else ""


def shared_mailbox(t: str) -> bool:
    """Whether the words of an address name a team, a list or a tool instead of a person."""
    p = email_parts(t)
    if not p:
        return False
    local = _SPLIT.split(p[0].split("+")[0].lower())
    host = _SPLIT.split(re.sub(_DOT, ".", p[1]).lower())
    whole = p[0].split("+")[0].lower()
    return whole in SHARED_LOCAL or (len(local) > 1 and bool(SHARED_LOCAL & set(local))) or (bool(host) and host[0] in SHARED_HOST)


def features(raw: str, given: frozenset[str]) -> tuple[list[str], str]:
    """Features of a token by itself, and its key as a neighbour."""
    t = raw.strip()
    if not t:
        return ["blank"], "blank"
    low = t.lower()
    f = ["bias"]
    if (parts := email_parts(t)) and len(t) > 4:
        f.append("email-shared" if shared_mailbox(t) else "email-own")
        host = parts[1]
        if not re.search(r"[A-Za-z]", host):
            f.append("email-version")
        return f, "<email>"
    digits = sum(c.isdigit() for c in t)
    s = shape(t)
    if digits:
        groups = "-".join(str(len(g)) for g in re.findall(r"\d+", t))
        seps = "".join(sorted(set(re.sub(r"[\w]", "", t))))
        letters = re.sub(r"[^A-Za-z]", "", t)
        f += [f"shape={s}", f"digits={min(digits, 20)}", f"groups={groups[:24]}", f"seps={seps}", f"start={'+' if t[0] == '+' else '(' if t[0] == '(' else '00' if t.startswith('00') else '0' if t[0] == '0' else 'L' if t[0].isalpha() else 'd'}"]
        if not letters:
            f.append("numeric")
        elif re.fullmatch(r"\d{1,4}[A-Za-z]?", t):
            f.append("house")
        if len(t) > 3 and re.fullmatch(r"[0-9a-f-]+", t) and letters:
            f.append("hexlike")
        key = "<house>" if re.fullmatch(r"\d{1,4}[A-Za-z]?", t) else f"<num{min(digits, 12)}>"
        return f, key
    if not t[0].isalpha():
        return [*f, f"w={low}", "punct"], low
    if len(t) == 1 and t.isupper():
        # A letter by itself is an article, a label or an initial; what follows tells.
        return [*f, "initial", "given-initial" if any(g[0] == low for g in given) else "other-initial", "compass" if low in "nesw" else "no-compass"], "<compass>" if low in "nesw" else "<initial>"
    f += [f"w={low}", f"s3={low[-3:]}", f"s4={low[-4:]}", f"p3={low[:3]}", f"len={min(len(low), 12)}", f"cap={s[:2] if len(s) > 1 else s}", "upper" if t.isupper() and len(t) > 1 else "title" if t[0].isupper() else "lower"]
    if low in given:
        f.append("given")
    if low in PARTICLES:
        f.append("particle")
    if low in TITLES:
        f.append("titleword")
    if low in STREETS or low.endswith(STREET_ENDS):
        f.append("street")
    if low in ID_WORDS:
        f.append("idword")
    if low in PHONE_WORDS:
        f.append("phoneword")
    if "'" in t or "-" in t:
        f.append("joined")
    key = "<given>" if low in given else "<street>" if (low in STREETS or low.endswith(STREET_ENDS)) else "<idword>" if low in ID_WORDS and low not in PLAIN_ID_WORDS else low
    return f, key
