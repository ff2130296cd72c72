"""Host names as browsers write them: UTS 46, non-transitional.

The mapping follows from Python's Unicode data by rule: compatibility forms
folded and composed, a few code points ignored, ideographic stops read as dots;
sharp s, final sigma and joiners stay as they are. A label is refused that
begins with a mark, holds what no host may hold, breaks the rule for texts from
right to left, or has a joiner that does not follow a virama.
"""

from __future__ import annotations

import re
import unicodedata
from urllib.parse import unquote_to_bytes

#: Fixed values of the standard: code points that a mapping drops, that stand for a dot, that stay.
IGNORED = frozenset([0x00AD, 0x034F, 0x200B, 0x2060, 0x2064, 0xFEFF, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0x1D173, 0x1D17B), *range(0xE0100, 0xE01F0)])
DOTS = frozenset("。．｡")
KEPT = frozenset("ßς‌‍")
JOINERS = frozenset("‌‍")
VIRAMA = 9
FORBIDDEN = re.compile(r"[\x00-\x20\x7f#/:<>?@\[\\\]^|%]")


def _mapped(text: str) -> str:
    out = []
    for c in text:
        if c in KEPT:
            out.append(c)
        elif c in DOTS:
            out.append(".")
        elif c == "ẞ":
            out.append("ß")
        elif ord(c) not in IGNORED:
            folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", c).casefold())
            out.append("".join(x for x in folded if ord(x) not in IGNORED))
    return unicodedata.normalize("NFC", "".join(out))


def _is_sound(label: str) -> bool:
    """Whether a label in Unicode may stand in a host."""
    if not label or unicodedata.normalize("NFC", label) != label or unicodedata.category(label[0])[0] == "M":
        return False
    for i, c in enumerate(label):
        if c in JOINERS:
            if not i or unicodedata.combining(label[i - 1]) != VIRAMA:
                return False
        elif unicodedata.category(c)[0] in "CZ" or c not in KEPT and _mapped(c) != c:
            return False
    return True


def _runs_well(label: str) -> bool:
    """The rule for labels of a host that has text from right to left."""
    kinds = [unicodedata.bidirectional(c) for c in label]
    ends = [k for k in kinds if k != "NSM"]
    if kinds[0] in ("R", "AL"):
        allowed = {"R", "AL", "AN", "EN", "ES", "CS", "ET", "ON", "BN", "NSM"}
        return set(kinds) <= allowed and ends[-1] in ("R", "AL", "EN", "AN") and not {"EN", "AN"} <= set(kinds)
    return kinds[0] == "L" and set(kinds) <= {"L", "EN", "ES", "CS", "ET", "ON", "BN", "NSM"} and ends[-1] in ("L", "EN")


def ascii_host(text: str) -> str | None:
    """A host in ASCII, lower case; None if it can be none."""
    if "%" in text:
        text = unquote_to_bytes(text).decode("utf-8", "replace")
    low = text.lower()
    if text.isascii() and "xn--" not in low:
        return None if not low or FORBIDDEN.search(low) else low
    out, plain = [], []
    for label in _mapped(text).split("."):
        if label.startswith("xn--"):
            try:
                shown = label[4:].encode("ascii").decode("punycode")
            except UnicodeError:
                return None
            if shown.isascii() or not _is_sound(shown) or shown.encode("punycode").decode() != label[4:]:
                return None
            out.append(label)
            plain.append(shown)
            continue
        if not label.isascii():
            if not _is_sound(label):
                return None
            out.append("xn--" + label.encode("punycode").decode())
        else:
            out.append(label)
        plain.append(label)
    if any(unicodedata.bidirectional(c) in ("R", "AL", "AN") for label in plain for c in label) and not all(_runs_well(x) for x in plain if x):
        return None
    host = ".".join(out)
    return None if not host or FORBIDDEN.search(host) else host
