"""A page as a stream of block tags and text slots, and union-free expressions over such streams.

An expression is a sequence of items ``[key, optional, repeated, inner]``. The key is a block tag, ``#`` for a slot of text, or ``()`` for
a group of several items; ``inner`` is the sequence inside it. There are no alternatives: where two streams differ, what one of
them has alone becomes optional, and what follows itself becomes repeated.
"""

from __future__ import annotations

import functools
import html as entities
import re
from collections.abc import Iterator

#: Elements nested deeper than this count as part of the last one that is not.
DEEPEST = 100
#: Longest run of items that is looked for as a repeated group.
LONGEST_GROUP = 4

_BLOCKS = frozenset("""address article aside audio blockquote body button canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5
h6 head header hgroup html legend li main menu nav object ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul video""".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_RAW = frozenset("script style title textarea noscript template svg iframe xmp noembed noframes datalist".split())
#: Never part of the text of an article, by tag, by role, or by a word of a class or an id.
_OUT_TAGS = frozenset("head nav footer aside form button select optgroup option dialog menu audio video canvas object search".split())
_OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
_OUT_WORDS = frozenset("""ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promotion cookie cookies consent gdpr notice notices popup
modal overlay newsletter subscribe subscription nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside footer masthead comment comments commentlist disqus reply replies
respond share sharing social related recommended recommendations widget widgets toolbar pagination pager login signup signin skip""".split())
#: Words that say so only where nothing else in the class says that it is the article's own.
_OUT_ALONE = frozenset("header banner side top bottom".split())
_OWN_WORDS = frozenset("article post entry content story body text page".split())
#: A start tag ends such open elements, up to the ones in the second place.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
         "th": ({"td", "th"}, {"tr", "table"}), "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
         "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"}), "optgroup": ({"option", "optgroup"}, {"select"}), "body": ({"head"}, {"html"})}
_P_STOPS = frozenset("table td th caption button object html body".split())

_TOKEN = re.compile(r"""<!--(?:.*?-->|.*)|<(/?)([a-zA-Z][^\s/>]*)((?:[^'">]|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>?""", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|itemprop|hidden|aria-hidden)(?=[\s=/]|$)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_SAYS = re.compile(r"\S")


class Node:
    """An element; ``kids`` are elements and raw strings."""

    __slots__ = ("name", "key", "kids", "inline")

    def __init__(self, name: str, key: str, inline: bool):
        self.name, self.key, self.inline, self.kids = name, key, inline, []


@functools.lru_cache(1 << 15)
def key_of(name: str, attributes: str) -> str:
    """The tag, with ``!`` if it holds nothing of an article, or ``*`` if it says that it is the main part."""
    out, words = name in _OUT_TAGS, set()
    main = name in ("article", "main")
    for m in _ATTRIBUTE.finditer(attributes):
        what, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if what in ("class", "id"):
            words.update(re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", m[2] or m[3] or m[4] or "").lower()))
        elif what == "role":
            out |= value in _OUT_ROLES
            main |= value in ("main", "article")
        elif what == "itemprop":
            main |= value == "articlebody"
            out |= value == "comment"
        elif what == "hidden" or value == "true":
            out = True
    if name in ("html", "body"):
        return name
    if main:
        out |= bool(words & {"comment", "comments", "ad", "ads", "advert", "sponsored", "related", "reply"})
    else:
        out |= bool(words & _OUT_WORDS) or bool(words & _OUT_ALONE) and not words & _OWN_WORDS
    return f"{name}!" if out else f"{name}*" if main else name


def parse(page: str) -> Node:
    """The elements of a page; ends that are left out are put where a browser would put them, as far as blocks go."""
    root = Node("", "", False)
    stack, beyond, at, inside_out = [root], {}, 0, 0

    def close(to: int) -> None:
        nonlocal inside_out
        while len(stack) > to:
            node = stack.pop()
            inside_out -= node.inline and node.key.endswith("!")

    def end(names, stops) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name in names:
                close(i)
                return end(names, stops) if len(names) > 1 else None
            if stack[i].name in stops:
                return None
        return None

    size = len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        if m is None:
            stack[-1].kids.append(page[at:])
            break
        if m.start() > at:
            stack[-1].kids.append(page[at:m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        name, closing, attributes = name.lower(), m[1] or m[4], m[3] or m[6] or ""
        block = name in _BLOCKS
        if closing:
            if beyond.get(name):
                beyond[name] -= 1
            elif name == "br":
                stack[-1].kids.append(" ")
            else:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].name == name:
                        close(i)
                        break
                    if not block and not stack[i].inline:
                        break
            continue
        if name in _RAW:
            found = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = found.end() if found else size
            continue
        if name in _VOID:
            stack[-1].kids.append(Node(name, name, False) if name == "hr" else " ")
            continue
        if block:
            end({"p"}, _P_STOPS)
            if name in _ENDS:
                end(*_ENDS[name])
        key = key_of(name, attributes.strip())
        if attributes.endswith("/") and not block:
            continue
        if not block and name != "a" and not inside_out and not key.endswith("!"):
            continue
        if len(stack) >= DEEPEST:
            beyond[name] = beyond.get(name, 0) + 1
            if block:
                stack[-1].kids.append(Node("hr", "hr", False))
            continue
        node = Node(name, key, not block)
        inside_out += node.inline and key.endswith("!")
        stack[-1].kids.append(node)
        stack.append(node)
    return root


def says(piece: str | Node) -> bool:
    """Whether there is anything but white space in a piece of text, or in an inline element."""
    return bool(_SAYS.search(piece)) if isinstance(piece, str) else any(map(says, piece.kids))


def plain(piece: str | Node) -> bool:
    """Whether a piece is part of a slot of text."""
    return isinstance(piece, str) or piece.inline and not piece.key.endswith("!")


def parts(node: Node) -> Iterator[tuple[str, list | Node]]:
    """The stream inside an element: ``(key, element)``, or ``("#", pieces)`` for a slot of text that is not blank."""
    run: list = []
    for kid in node.kids:
        if plain(kid):
            run.append(kid)
            continue
        if any(map(says, run)):
            yield "#", run
        run = []
        yield kid.key, kid
    if any(map(says, run)):
        yield "#", run


def stream(node: Node) -> list[list]:
    """The expression of what is in one element. What is in an element that holds nothing of an article is not looked at."""
    return folded([[key, False, False, [] if key == "#" or key.endswith("!") else stream(part)] for key, part in parts(node)])


def _keys(items: list[list]) -> list:
    return [i[0] if i[0] != "()" else ("()", *_keys(i[3])) for i in items]


def _both(a: list, b: list, optional: bool, repeated: bool) -> list:
    return [a[0], optional, repeated, a[3] if a[3] == b[3] else merged(a[3], b[3])]


def folded(items: list[list]) -> list[list]:
    """Repeated items, and repeated groups of a few items, as one."""
    out: list[list] = []
    for item in items:
        out.append(item)
        again = True
        while again:
            again = False
            if len(out) > 1 and _keys(out[-1:]) == _keys(out[-2:-1]):
                b, a = out.pop(), out.pop()
                out.append(_both(a, b, a[1] and b[1], True))
                again = True
                continue
            for size in range(2, LONGEST_GROUP + 1):
                if len(out) > size and out[-size - 1][0] == "()" and _keys(out[-size - 1][3]) == _keys(out[-size:]):
                    unit = out[-size:]
                    del out[-size:]
                    out[-1] = ["()", out[-1][1], True, [_both(a, b, a[1] or b[1], a[2] or b[2]) for a, b in zip(out[-1][3], unit)]]
                    again = True
                elif len(out) >= 2 * size and _keys(out[-size:]) == _keys(out[-2 * size:-size]):
                    two, one = out[-size:], out[-2 * size:-size]
                    del out[-2 * size:]
                    out.append(["()", False, True, [_both(a, b, a[1] or b[1], a[2] or b[2]) for a, b in zip(one, two)]])
                    again = True
                if again:
                    break
    return out


def merged(one: list[list], two: list[list]) -> list[list]:
    """An expression for what either of two stands for: aligned from the left, at a mismatch the nearer of the two next agreements."""
    if one == two:
        return one
    out: list[list] = []
    i = j = 0
    while i < len(one) and j < len(two):
        a, b = one[i], two[j]
        if _keys([a]) == _keys([b]):
            out.append(_both(a, b, a[1] or b[1], a[2] or b[2]))
            i, j = i + 1, j + 1
            continue
        size_a, size_b = (len(x[3]) if x[0] == "()" else 0 for x in (a, b))
        if size_a and _keys(a[3]) == _keys(two[j:j + size_a]):  # one turn of a group
            out.append(["()", a[1], True, [_both(x, y, x[1] or y[1], x[2] or y[2]) for x, y in zip(a[3], two[j:j + size_a])]])
            i, j = i + 1, j + size_a
            continue
        if size_b and _keys(b[3]) == _keys(one[i:i + size_b]):
            out.append(["()", b[1], True, [_both(x, y, x[1] or y[1], x[2] or y[2]) for x, y in zip(b[3], one[i:i + size_b])]])
            i, j = i + size_b, j + 1
            continue
        ahead_one = next((k - i for k in range(i + 1, len(one)) if _keys(one[k:k + 1]) == _keys([b])), None)
        ahead_two = next((k - j for k in range(j + 1, len(two)) if _keys(two[k:k + 1]) == _keys([a])), None)
        if ahead_one is None and ahead_two is None:
            out += [[a[0], True, *a[2:]], [b[0], True, *b[2:]]]
            i, j = i + 1, j + 1
        elif ahead_two is None or ahead_one is not None and ahead_one <= ahead_two:
            out += [[x[0], True, *x[2:]] for x in one[i:i + ahead_one]]
            i += ahead_one
        else:
            out += [[x[0], True, *x[2:]] for x in two[j:j + ahead_two]]
            j += ahead_two
    return folded(out + [[x[0], True, *x[2:]] for x in one[i:]] + [[x[0], True, *x[2:]] for x in two[j:]])


class Place:
    """An item of an expression, with its number; the inner sequence has its groups laid out."""

    __slots__ = ("key", "repeated", "number", "inner", "turn")

    def __init__(self, key: str, repeated: bool, number: int, inner: list, turn: int | None):
        self.key, self.repeated, self.number, self.inner, self.turn = key, repeated, number, inner, turn


def laid_out(items: list[list], counter: Iterator[int]) -> list[Place]:
    """The items in a row; those of a group know where its turn begins."""
    out: list[Place] = []

    def put(seq: list[list], turn: int | None) -> None:
        for key, _, repeated, inner in seq:
            if key == "()":
                put(inner, len(out) if turn is None else turn)
            else:
                out.append(Place(key, repeated, next(counter), laid_out(inner, counter), turn))

    put(items, None)
    return out


def matched(node: Node, places: list[Place]) -> Iterator[tuple[str, list | Node, Place | None]]:
    """The stream inside an element beside the items of an expression it stands at; None where it fits nowhere."""
    at = 0
    for key, part in parts(node):
        ahead = next((k for k in range(at, len(places)) if places[k].key == key), None)
        if at and at <= len(places) and (turn := places[min(at, len(places)) - 1].turn) is not None:
            back = next((k for k in range(turn, at) if places[k].key == key and places[k].turn == turn), None)
            if back is not None and (ahead is None or places[ahead].turn != turn):
                ahead = back
        if ahead is None:
            yield key, part, None
        else:
            at = ahead if places[ahead].repeated else ahead + 1
            yield key, part, places[ahead]


def spelled(pieces: list) -> str:
    """The text of pieces, references decoded; white space is left."""
    out = []
    for p in pieces:
        out.append(entities.unescape(p) if isinstance(p, str) else spelled([k for k in p.kids if plain(k)]))
    return "".join(out)


def linked(pieces: list) -> int:
    """How many characters of pieces are in links."""
    return sum(len(spelled(p.kids).strip()) if p.name == "a" else linked(p.kids) for p in pieces if not isinstance(p, str))
