"""Names as people type them: one core form, and whether two forms name the same payee.

The core form leaves out what says nothing about who is meant: case, accents,
separators, terminal and store labels, places set apart by a colon or a dash,
articles and legal forms. Two core forms are compared token by token through
their longest common subsequence (LCS).
"""

from __future__ import annotations

import re
import unicodedata

# Words without meaning for identity, legal forms, short forms of first names.
NOISE = frozenset("the and sons son by pos terminal store sq tst paypal pp sp".split())
LEGAL = frozenset("inc incorporated corp corporation co company ltd limited llc llp lp plc gmbh".split())
NICKNAMES = {
    "anthony": "tony ant", "isabella": "bella izzy belle isa", "william": "will bill billy willie willy",
    "zachary": "zack zach zak", "harold": "harry hal", "margaret": "maggie meg peggy marge madge margie greta",
    "katherine": "kate kathy katie kat kay kit katy", "robert": "rob bob bobby robbie bert", "theodore": "ted theo teddy",
    "charles": "chuck charlie chas chaz charley", "nathaniel": "nat nate nathan", "ulysses": "uly lys",
    "stephanie": "steph steffi stevie steffie stephie", "elizabeth": "betty liz beth lizzie eliza bess betsy libby lisa",
    "lawrence": "larry lars laurie", "dorothy": "dottie dot dolly dory dora", "frederick": "fred freddy freddie fritz rick",
    "josephine": "josie jo joey jody", "virginia": "ginny ginger gina virgie", "james": "jim jimmy jamie", "john": "jack johnny",
    "richard": "rich dick richie", "thomas": "tom tommy", "michael": "mike mick mickey", "edward": "ed eddie ned",
    "alexander": "alex sandy", "andrew": "andy drew", "benjamin": "ben benny", "daniel": "dan danny", "david": "dave davy",
    "joseph": "joe", "samuel": "sam sammy", "patricia": "pat patty trish", "susan": "sue susie", "barbara": "barb babs",
    "catherine": "cathy cat", "rebecca": "becky becca", "deborah": "deb debbie", "christopher": "chris kit", "matthew": "matt",
    "abigail": "abby gail", "victoria": "vicky tori", "jennifer": "jen jenny", "gregory": "greg", "jeffrey": "jeff", "timothy": "tim",
}
FULL_NAME = {short: full for full, shorts in NICKNAMES.items() for short in shorts.split()}

LONGEST = 256
_legal_known: dict[str, bool] = {}
CUT_NOISE = frozenset("an so".split())
_LONG_LEGAL = tuple(sorted(w for w in LEGAL if len(w) >= 7))
_LABEL = re.compile(r"^\s*[a-z]{2,7}\s*\*+\s*(?=\S)")
_NUMBERED = re.compile(r"#\s*\d.*$", re.S)
_PLACE_BEFORE = re.compile(r"^[^:]{1,40}:\s+(?=\S+\s+\S)", re.S)
_PLACE_AFTER = re.compile(r"(\S\s+\S.*\S)\s+-\s+\S[^-,|/]{0,40}$", re.S)
_CAMEL = re.compile(r"(?:[A-Z][a-z]+){2,}")
_WORDS = re.compile(r"[^\W_]+")


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel counting."""
    if len(a) > len(b):
        a, b = b, a
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for ch in b:
        u = v & where.get(ch, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _legal_end(text: str) -> bool:
    """Whether a name written without blanks may end in this: a legal form, whole, mistyped or cut off."""
    return _legal(text) or (len(text) >= 2 and any(w.startswith(text) for w in LEGAL))


def _legal(word: str) -> bool:
    if word in LEGAL:
        return True
    if len(word) < 4:
        return False
    known = _legal_known.get(word)
    if known is None:
        if len(_legal_known) >= 1 << 16:
            _legal_known.clear()
        known = any(w.startswith(word) or (abs(len(w) - len(word)) <= 1 and lcs(w, word) >= max(len(w), len(word)) - 1) for w in _LONG_LEGAL)
        _legal_known[word] = known
    return known


def core(name: str | None) -> str:
    """Core form: its tokens in order, joined by blanks ('' for null, blank or sign-only names)."""
    if not name:
        return ""
    if _CAMEL.fullmatch(name.strip()):
        name = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", name)
    text = name.lower() if name.isascii() else "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c)).casefold()
    text = _LABEL.sub("", text) if "*" in text else text
    text = _NUMBERED.sub("", text) if "#" in text else text
    text = _PLACE_BEFORE.sub("", text) if ":" in text else text
    text = _PLACE_AFTER.sub(r"\1", text) if "-" in text else text
    if "&" in text and not re.search(r"\s", text.strip()):
        text = re.sub(r"&(?:sons)?", "", text)
    words = _WORDS.findall(text)
    kept = [w for w in words if w not in NOISE and not w.isdigit()]
    firm = [w for w in kept if not _legal(w)]
    kept = firm if firm else kept
    if len(kept) > 2 and kept[-1] in CUT_NOISE:
        kept = kept[:-1]
    long = [w for w in kept if len(w) > 1]
    if len(long) >= 2:
        kept = long
    return " ".join(kept or words)


def sorted_key(form: str) -> str:
    """The same for every order of the tokens."""
    return " ".join(sorted(form.split(" ")))


def slip(x: str, y: str, edits: int = 1) -> bool:
    """Whether two different tokens are a typo apart: all letters but one are common and in order.

    With ``edits`` 2, all but two of tokens of six letters or more. Tokens of fewer
    than four or more than ``LONGEST`` letters are never a typo apart.
    """
    if len(x) > len(y):
        x, y = y, x
    allowed = edits if len(x) >= 6 else 1
    return 4 <= len(x) and len(y) <= LONGEST and x != y and len(y) - len(x) <= allowed and lcs(x, y) >= len(y) - allowed


def _token(x: str, y: str, edits: int = 1) -> str | None:
    """How two tokens agree: equal, typo, short (abbreviated, cut off or a nickname), initial, or not at all.

    With ``edits`` 2, a short form may lack a letter of the other, and two short
    forms of up to four letters agree if they begin alike.
    """
    if x == y:
        return "equal"
    fx, fy = FULL_NAME.get(x, x), FULL_NAME.get(y, y)
    if fx == fy:
        return "short"
    if len(x) > len(y):
        x, y = y, x
    if slip(x, y, edits):
        return "typo"
    if {fx, fy} != {x, y} and slip(fx, fy):
        return "short"
    if x[0] != y[0]:
        return None
    if len(x) == 1:
        return "initial"
    if y.startswith(x) or (len(x) <= 6 and lcs(x, y) == len(x)):
        return "short"
    if edits > 1 and (len(y) <= 4 or (len(x) >= 3 and (len(x) <= 6 or x[:3] == y[:3]) and lcs(x, y) >= len(x) - 1)):
        return "short"
    return None


STRONG, WEAK = "strong", "weak"


def relation(a: str, b: str, edits: int = 1, anchor: int = 5, ratio: float = 0.5) -> tuple[str, int] | None:
    """(``strong`` or ``weak``, letters in pairs of equal or nearly equal tokens) for two core forms, or None.

    Strong: the tokens pair off in any order, at most ``edits`` pairs by a typo, at
    least one pair of ``anchor`` letters or more equal or nearly so, the others
    equal or abbreviated, and twice the common subsequences of the pairs (a short
    form counts with its own letters) are at least ``ratio`` of all letters; or one form is the other written without blanks.
    Weak: the same, but one form has up to three tokens more, or an initial
    stands for a whole name; such a link counts only if it is unambiguous.
    """
    ta, tb = a.split(" "), b.split(" ")
    if len(ta) > len(tb):
        ta, tb, a, b = tb, ta, b, a
    if len(ta) == 1:
        return _unspaced(a, tb, anchor, edits)
    if len(tb) - len(ta) > 3:
        return None
    left, typos, firm, shared, weak = list(tb), 0, 0, 0, len(tb) > len(ta)
    rank = {"equal": 0, "typo": 1, "short": 2, "initial": 3}
    anchored = False
    for x in sorted(ta, key=len, reverse=True):
        best = min(((rank[k], y, k) for y in left if (k := _token(x, y, edits))), default=None)
        if best is None:
            return None
        _, y, kind = best
        left.remove(y)
        typos += kind == "typo"
        if typos > edits:
            return None
        weak |= kind == "initial"
        shared += min(len(x), len(y)) if kind in ("equal", "short", "initial") else lcs(x, y)
        if kind in ("equal", "typo"):
            firm += min(len(x), len(y))
            anchored |= min(len(x), len(y)) >= anchor
    if not anchored:
        return None
    if weak:
        return WEAK, firm
    return (STRONG, firm) if 2 * shared >= ratio * (sum(map(len, ta)) + sum(map(len, tb))) else None


def _unspaced(a: str, tb: list[str], anchor: int, edits: int = 1) -> tuple[str, int] | None:
    """Relation of a form of one token to another form: to one of its tokens, or to it written without blanks."""
    joined = "".join(tb)
    near = a == joined or slip(a, joined)
    if len(tb) == 1:
        return (STRONG, len(a)) if len(a) >= 6 and (near or slip(a, joined, edits)) else None
    if len(a) >= 6 and len(tb) <= 4 and any(a == t or slip(a, t) for t in tb):
        return WEAK, len(a)
    if len(a) < 10:
        return None
    if near or (a.startswith(joined) and _legal_end(a[len(joined) :])):
        return STRONG, len(joined)
    for i, first in enumerate(tb):
        if anchor <= len(first) <= LONGEST and a.startswith(first):
            rest, more = re.sub("^sons|and", "", a[len(first) :]), "".join(tb[i + 1 :] + tb[:i])
            if len(rest) >= 2 and rest[0] == more[0] and (lcs(rest, more) == len(rest) or (len(more) >= 5 and rest.startswith(more))):
                return WEAK, len(first)
            if edits > 1 and min(len(rest), len(more)) >= 4 and rest[0] == more[0] and lcs(rest, more) >= min(len(rest), len(more)) - 1:
                return WEAK, len(first)
    return None
