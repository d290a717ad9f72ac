"""Computed colours and fonts of the elements of one HTML page; runs inside the parser pass.

The page's own style sheets and style attributes apply over a short base sheet, by selector,
specificity, order and importance; colours of text and fonts are inherited. Style sheets in other files,
scripts and states such as ``:hover`` have no part in it.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

# Elements without an end, elements that the start of another one ends, and those of the head.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
)
_ENDED_BY = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option", "optgroup"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "p": _ENDS_P, "a": frozenset(["a"]), "button": frozenset(["button"]),
}
_SCOPES = frozenset("ul ol dl table select td th body html".split())
_HEAD = frozenset("title meta link style script base noscript template".split())
FONT_TAGS = frozenset("h1 h2 h3 h4 h5 h6 p a span button li label".split())
SIDES = ("top", "right", "bottom", "left")
SIZES = {"xx-small": 9, "x-small": 10, "small": 13, "medium": 16, "large": 18, "x-large": 24, "xx-large": 32}
# The named colours of CSS.
_NAMED = dict(
    pair.split(":")
    for pair in (
        "aliceblue:f0f8ff antiquewhite:faebd7 aqua:00ffff aquamarine:7fffd4 azure:f0ffff beige:f5f5dc bisque:ffe4c4 black:000000"
        " blanchedalmond:ffebcd blue:0000ff blueviolet:8a2be2 brown:a52a2a burlywood:deb887 cadetblue:5f9ea0 chartreuse:7fff00 chocolate:d2691e"
        " coral:ff7f50 cornflowerblue:6495ed cornsilk:fff8dc crimson:dc143c cyan:00ffff darkblue:00008b darkcyan:008b8b darkgoldenrod:b8860b"
        " darkgray:a9a9a9 darkgreen:006400 darkgrey:a9a9a9 darkkhaki:bdb76b darkmagenta:8b008b darkolivegreen:556b2f darkorange:ff8c00"
        " darkorchid:9932cc darkred:8b0000 darksalmon:e9967a darkseagreen:8fbc8f darkslateblue:483d8b darkslategray:2f4f4f darkslategrey:2f4f4f"
        " darkturquoise:00ced1 darkviolet:9400d3 deeppink:ff1493 deepskyblue:00bfff dimgray:696969 dimgrey:696969 dodgerblue:1e90ff"
        " firebrick:b22222 floralwhite:fffaf0 forestgreen:228b22 fuchsia:ff00ff gainsboro:dcdcdc ghostwhite:f8f8ff gold:ffd700 goldenrod:daa520"
        " gray:808080 green:008000 greenyellow:adff2f grey:808080 honeydew:f0fff0 hotpink:ff69b4 indianred:cd5c5c indigo:4b0082 ivory:fffff0"
        " khaki:f0e68c lavender:e6e6fa lavenderblush:fff0f5 lawngreen:7cfc00 lemonchiffon:fffacd lightblue:add8e6 lightcoral:f08080"
        " lightcyan:e0ffff lightgoldenrodyellow:fafad2 lightgray:d3d3d3 lightgreen:90ee90 lightgrey:d3d3d3 lightpink:ffb6c1 lightsalmon:ffa07a"
        " lightseagreen:20b2aa lightskyblue:87cefa lightslategray:778899 lightslategrey:778899 lightsteelblue:b0c4de lightyellow:ffffe0 lime:00ff00"
        " limegreen:32cd32 linen:faf0e6 magenta:ff00ff maroon:800000 mediumaquamarine:66cdaa mediumblue:0000cd mediumorchid:ba55d3"
        " mediumpurple:9370db mediumseagreen:3cb371 mediumslateblue:7b68ee mediumspringgreen:00fa9a mediumturquoise:48d1cc mediumvioletred:c71585"
        " midnightblue:191970 mintcream:f5fffa mistyrose:ffe4e1 moccasin:ffe4b5 navajowhite:ffdead navy:000080 oldlace:fdf5e6 olive:808000"
        " olivedrab:6b8e23 orange:ffa500 orangered:ff4500 orchid:da70d6 palegoldenrod:eee8aa palegreen:98fb98 paleturquoise:afeeee"
        " palevioletred:db7093 papayawhip:ffefd5 peachpuff:ffdab9 peru:cd853f pink:ffc0cb plum:dda0dd powderblue:b0e0e6 purple:800080"
        " rebeccapurple:663399 red:ff0000 rosybrown:bc8f8f royalblue:4169e1 saddlebrown:8b4513 salmon:fa8072 sandybrown:f4a460 seagreen:2e8b57"
        " seashell:fff5ee sienna:a0522d silver:c0c0c0 skyblue:87ceeb slateblue:6a5acd slategray:708090 slategrey:708090 snow:fffafa"
        " springgreen:00ff7f steelblue:4682b4 tan:d2b48c teal:008080 thistle:d8bfd8 tomato:ff6347 turquoise:40e0d0 violet:ee82ee wheat:f5deb3"
        " white:ffffff whitesmoke:f5f5f5 yellow:ffff00 yellowgreen:9acd32"
    ).split()
)
_WIDE = frozenset(["inherit", "initial", "unset", "revert"])
CLEAR, BLACK = "rgba(0, 0, 0, 0)", "rgb(0, 0, 0)"


# --- the element tree ------------------------------------------------------------------------
class Element:
    __slots__ = ("tag", "attrs", "parent", "before", "first", "last", "classes", "style")

    def __init__(self, tag: str, attrs: dict, parent: Element | None, before: Element | None):
        self.tag, self.attrs, self.parent, self.before = tag, attrs, parent, before
        self.first, self.last = before is None, True
        self.classes = frozenset(attrs.get("class", "").split())
        self.style: dict[str, str] = {}


class _Tree(HTMLParser):
    """All elements in document order, with html, head and body also where they are not written."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.elements: list[Element] = []
        self.youngest: dict[int, Element] = {}
        self.sheets: list[tuple[str, str]] = []
        self.open: list[Element] = []
        self.body: Element | None = None
        self.html = self._add("html", {})
        self.head = self._add("head", {})

    def _add(self, tag: str, attrs: dict) -> Element:
        parent = self.open[-1] if self.open else None
        before = self.youngest.get(id(parent))
        if before is not None:
            before.last = False
        element = Element(tag, attrs, parent, before)
        self.youngest[id(parent)] = element
        self.elements.append(element)
        if tag not in _VOID:
            self.open.append(element)
        return element

    def _enter_body(self, attrs: dict | None = None) -> None:
        if self.body is None:
            self.open = [self.html]
            self.body = self._add("body", attrs or {})

    def _close_for(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if tag in _ENDED_BY.get(self.open[i].tag, ()):
                del self.open[i:]
            elif self.open[i].tag in _SCOPES:
                return

    def handle_starttag(self, tag: str, pairs: list) -> None:
        attrs = {name: value or "" for name, value in reversed(pairs)}
        if tag in ("html", "head", "body"):
            if tag == "body":
                self._enter_body(attrs)
            target = {"html": self.html, "head": self.head, "body": self.body}[tag]
            target.attrs = attrs | target.attrs
            target.classes = frozenset(target.attrs.get("class", "").split())
            return
        if self.body is None and tag not in _HEAD:
            self._enter_body()
        self._close_for(tag)
        self._add(tag, attrs)

    def handle_startendtag(self, tag: str, pairs: list) -> None:
        self.handle_starttag(tag, pairs)

    def handle_endtag(self, tag: str) -> None:
        if tag == "head" and self.body is None:
            self.open = [self.html]
        if tag in ("html", "head", "body"):
            return
        for i in range(len(self.open) - 1, 1, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        top = self.open[-1]
        if top.tag == "style":
            self.sheets.append((data, top.attrs.get("media", "")))
        elif self.body is None and top.tag not in _HEAD and data.strip():
            self._enter_body()


# --- style sheets ----------------------------------------------------------------------------
def media_applies(query: str, width: int) -> bool:
    """Whether a list of media queries holds for a screen of this width; unknown conditions do not hold."""
    for one in query.lower().split(","):
        held = True
        for part in re.split(r"\band\b", one):
            part = part.strip()
            limit = re.fullmatch(r"\(\s*(min|max)-width\s*:\s*(\d+(?:\.\d+)?)(px|em|rem)\s*\)", part)
            if limit:
                pixels = float(limit[2]) * (1 if limit[3] == "px" else 16)
                held &= width >= pixels if limit[1] == "min" else width <= pixels
            else:
                held &= part in ("", "all", "screen", "only screen", "only all")
        if held:
            return True
    return False


def sheet_rules(css: str, width: int):
    """(selectors, declarations) of the rules that apply, in order."""
    css = re.sub(r"(?s)/\*.*?(?:\*/|\Z)|<!--|-->", " ", css)
    blocks: list[bool] = []
    head, body = "", None
    for token in re.findall(r"(?s)\"[^\"]*\"?|'[^']*'?|[^{};\"']+|[{};]", css):
        if body is not None:
            if token == "}":
                if all(blocks):
                    yield head, body
                head, body = "", None
            else:
                body += token
        elif token == "{":
            head = head.strip()
            at = head.lower()
            if not head.startswith("@"):
                body = ""
                continue
            blocks.append(at.startswith("@media") and media_applies(head[6:], width))
            head = ""
        elif token == "}":
            if blocks:
                blocks.pop()
            head = ""
        else:
            head = "" if token == ";" else head + token
    if body is not None and all(blocks):
        yield head, body


def color_of(value: str) -> str | None:
    """A colour as a browser reports it, a keyword, or null."""
    value = value.strip().lower()
    if value in _WIDE or value == "currentcolor":
        return value
    if value == "transparent":
        return CLEAR
    if found := re.fullmatch(r"#([0-9a-f]{3,4}|[0-9a-f]{6}|[0-9a-f]{8})", "#" + _NAMED[value] if value in _NAMED else value):
        digits = found[1] if len(found[1]) > 4 else "".join(c + c for c in found[1])
        numbers = [int(digits[i : i + 2], 16) for i in range(0, len(digits), 2)]
        return _rgb(*numbers[:3], numbers[3] / 255 if len(numbers) == 4 else 1)
    found = re.fullmatch(r"(rgb|hsl)a?\(([^()]*)\)", value)
    if not found:
        return None
    parts = [p for p in re.split(r"[\s,/]+", found[2].strip()) if p]
    try:
        alpha = _share(parts[3]) if len(parts) == 4 else 1.0
        if len(parts) not in (3, 4):
            return None
        if found[1] == "rgb":
            return _rgb(*(float(p[:-1]) * 2.55 if p.endswith("%") else float(p) for p in parts[:3]), alpha)
        hue, strength, light = float(parts[0].removesuffix("deg")) / 30, _share(parts[1]), _share(parts[2])
    except ValueError:
        return None
    reach = strength * min(light, 1 - light)
    return _rgb(*(255 * (light - reach * max(-1, min(k - 3, 9 - k, 1))) for k in ((n + hue) % 12 for n in (0, 8, 4))), alpha)


def _share(text: str) -> float:
    return float(text[:-1]) / 100 if text.endswith("%") else float(text)


def _rgb(r: float, g: float, b: float, alpha: float) -> str:
    numbers = [min(255, max(0, int(x + 0.5))) for x in (r, g, b)]
    alpha = min(1.0, max(0.0, alpha))
    return "rgb({}, {}, {})".format(*numbers) if alpha == 1 else "rgba({}, {}, {}, {:g})".format(*numbers, round(alpha, 3))


def _words(value: str) -> list[str]:
    return re.findall(r"(?:[^\s(\"',]|\([^)]*\)|\"[^\"]*\"|'[^']*')+|,", value)


def _first_color(value: str) -> str | None:
    return next((c for w in _words(value) if (c := color_of(w)) and c not in _WIDE), None)


def declarations(text: str):
    """(property, value, important) in longhands; invalid values drop, as they do in a browser."""
    for name, value in re.findall(r"([-\w]+)\s*:((?:\"[^\"]*\"|'[^']*'|\([^)]*\)|[^;\"'(])+)", text):
        name, value = name.lower(), value.strip()
        plain = re.sub(r"(?i)\s*!\s*important$", "", value)
        important, value = plain != value, plain
        wide = value.lower() if value.lower() in _WIDE else None
        found: dict[str, str | None] = {}
        if name == "color" or name == "background-color" or re.fullmatch("border-(top|right|bottom|left)-color", name):
            found[name] = color_of(value)
        elif name == "background":
            found["background-color"] = wide or _first_color(value) or CLEAR
        elif name == "border-color":
            given = [color_of(w) for w in _words(value)]
            if 1 <= len(given) <= 4 and all(given):
                given += [given[0]] * (len(given) == 1)
                given += given[len(given) - 2 : len(given) - 1] if len(given) == 3 else []
                given = (given + given)[:4] if len(given) == 2 else [*given[:3], given[1]] if len(_words(value)) == 3 else given
                found = {f"border-{s}-color": c for s, c in zip(SIDES, given, strict=True)}
        elif name == "border" or re.fullmatch("border-(top|right|bottom|left)", name):
            color = wide or _first_color(value) or "currentcolor"
            found = {f"border-{s}-color": color for s in (SIDES if name == "border" else (name[7:],))}
        elif name == "font-family":
            found[name] = wide or _family(value)
        elif name == "font-size":
            found[name] = wide or _size(value)
        elif name == "font-weight":
            found[name] = wide or _weight(value)
        elif name == "font" and wide:
            found = dict.fromkeys(("font-family", "font-size", "font-weight"), wide)
        elif name == "font":
            given = re.fullmatch(r"(?s)((?:(?:italic|oblique|normal|small-caps|bold|bolder|lighter|\d{3})\s+)*)([\w.%-]+)(?:\s*/\s*[\w.%]+)?\s+(.+)", value)
            if given and _size(given[2]):
                weight = next((x for w in given[1].split() if w != "normal" and (x := _weight(w))), "400")
                found = {"font-family": _family(given[3]), "font-size": _size(given[2]), "font-weight": weight}
        for key, one in found.items():
            if one:
                yield key, one, important


def _family(value: str) -> str:
    names = [re.sub(r"\s+", " ", n.strip()) for n in re.findall(r"(?:\"[^\"]*\"|'[^']*'|[^,\"'])+", value)]
    return ", ".join('"' + n[1:-1] + '"' if n[:1] == "'" else n for n in names if n)


def _size(value: str) -> str | None:
    value = value.strip().lower()
    return value if value in SIZES or value in ("smaller", "larger") or re.fullmatch(r"\+?(\d+\.?\d*|\.\d+)(px|pt|em|rem|%)|0", value) else None


def _weight(value: str) -> str | None:
    value = {"normal": "400", "bold": "700"}.get(value.strip().lower(), value.strip().lower())
    return value if value in ("bolder", "lighter") or re.fullmatch(r"\d{1,3}|1000", value) and int(value) else None


# --- selectors -------------------------------------------------------------------------------
_SIMPLE = re.compile(
    r"(?P<tag>\*|[a-zA-Z][\w-]*)|#(?P<id>[\w-]+)|\.(?P<class>[\w-]+)"
    r"|\[\s*(?P<name>[\w:-]+)\s*(?:(?P<op>[~|^$*]?=)\s*(?P<value>\"[^\"]*\"|'[^']*'|[^\s\]]+)\s*)?\]|(?P<pseudo>::?[\w-]+(?:\([^)]*\))?)"
)
_PSEUDO = frozenset([":root", ":first-child", ":last-child", ":only-child", ":link", ":any-link"])
_TESTS = {
    "=": lambda a, v: a == v, "~=": lambda a, v: v in a.split(), "|=": lambda a, v: a == v or a.startswith(v + "-"),
    "^=": lambda a, v: v != "" and a.startswith(v), "$=": lambda a, v: v != "" and a.endswith(v), "*=": lambda a, v: v != "" and v in a,
}


def selectors(text: str):
    """(steps, specificity) of each selector of a list: steps are (combinator to the left, compound), from the right."""
    for one in re.split(r",(?![^(\[]*[)\]])", text):
        marked = re.sub(r"\s*([>+~])(?!=)\s*(?![^\[]*\])", r" \1 ", one.strip())
        parts = re.findall(r"(?:\[[^\]]*\]|\([^)]*\)|[^\s\[(])+", marked)
        steps, weight, joint = [], [0, 0, 0], " "
        for part in parts:
            if part in (">", "+", "~"):
                joint = part
                continue
            compound, at = [], 0
            while at < len(part) and (found := _SIMPLE.match(part, at)):
                kind, at = found.lastgroup if found["name"] is None else "attr", found.end()
                if found["pseudo"] and found["pseudo"].lower() not in _PSEUDO:
                    break
                if kind == "attr":
                    value = found["value"] or ""
                    value = value[1:-1] if value[:1] in "\"'" and value else value
                    compound.append(("attr", found["name"].lower(), found["op"], value))
                else:
                    compound.append((kind, found[kind] if kind in ("id", "class") else found[kind].lower()))
                weight[0 if kind == "id" else 2 if kind == "tag" else 1] += found["tag"] != "*"
            else:
                if at == len(part) and compound:
                    steps.append((joint, compound))
                    joint = " "
                    continue
            steps = []
            break
        if steps:
            yield steps[::-1], tuple(weight)


def _fits(element: Element, compound: list[tuple]) -> bool:
    for kind, name, *more in compound:
        if kind == "tag":
            ok = name in ("*", element.tag)
        elif kind == "id":
            ok = element.attrs.get("id") == name
        elif kind == "class":
            ok = name in element.classes
        elif kind == "attr":
            ok = name in element.attrs and (more[0] is None or _TESTS[more[0]](element.attrs[name], more[1]))
        else:
            ok = {
                ":root": element.parent is None, ":first-child": element.first, ":last-child": element.last, ":only-child": element.first and element.last,
            }.get(name, element.tag in ("a", "area") and "href" in element.attrs)
        if not ok:
            return False
    return True


def matches(element: Element, steps: list[tuple], i: int = 0) -> bool:
    if not _fits(element, steps[i][1]):
        return False
    if i + 1 == len(steps):
        return True
    joint = steps[i][0]
    step = (lambda e: e.parent) if joint in " >" else (lambda e: e.before)
    other = step(element)
    while other is not None:
        if matches(other, steps, i + 1):
            return True
        if joint in ">+":
            return False
        other = step(other)
    return False


def _key(compound: list[tuple]) -> tuple[str, str]:
    """What an element needs at least, so that it meets only rules that may fit."""
    simple = {kind: name for kind, name, *_ in compound}
    return next(((k, simple[k]) for k in ("id", "class", "tag") if simple.get(k, "*") != "*"), ("tag", "*"))


# --- computed values -------------------------------------------------------------------------
def _computed(element: Element, declared: dict[str, str], root_size: float) -> dict:
    above = element.parent.style if element.parent else {"color": BLACK, "font-family": "", "font-size": 16.0, "font-weight": 400}

    def given(name: str, inherited: bool, initial):
        value = declared.get(name)
        if value == "inherit" or (value in (None, "unset", "revert") and inherited):
            return above.get(name, initial)
        return initial if value in (None, "initial", "unset", "revert") else value

    style = {"color": given("color", True, BLACK)}
    if style["color"] == "currentcolor":
        style["color"] = above["color"]
    for name in ("background-color", *(f"border-{s}-color" for s in SIDES)):
        value = given(name, False, CLEAR if name == "background-color" else "currentcolor")
        style[name] = style["color"] if value == "currentcolor" else value
    style["font-family"] = given("font-family", True, "")
    size = given("font-size", True, 16.0)
    if isinstance(size, str):
        number, unit = re.fullmatch(r"\+?([\d.]*)(.*)", size).groups()
        scale = {"px": 1, "pt": 4 / 3, "em": above["font-size"], "rem": root_size, "%": above["font-size"] / 100, "": 1}
        size = SIZES[size] if size in SIZES else above["font-size"] * (1.2 if size == "larger" else 1 / 1.2) if not number else float(number) * scale[unit]
    style["font-size"] = float(size)
    weight = given("font-weight", True, 400)
    if weight in ("bolder", "lighter"):
        old = above["font-weight"]
        steps = ((350, 400), (550, 700), (900, 900)) if weight == "bolder" else ((550, 100), (750, 400), (1001, 700))
        weight = next((to for limit, to in steps if old < limit), old)
    style["font-weight"] = int(weight)
    return style


def _border(style: dict) -> str:
    """The four colours in the shortest form."""
    top, right, bottom, left = (style[f"border-{s}-color"] for s in SIDES)
    given = [top, right, bottom, left]
    if right == left:
        given = [top, right, bottom] if top != bottom else [top, right] if top != right else [top]
    return " ".join(given)


def cascade(html: str | None, base: str, width: int, most: int | None = None) -> list[Element]:
    """Elements of the page in document order, or the first ``most``, with their computed style."""
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    tree._enter_body()
    rules: dict[tuple[str, str], list] = {}
    order = 0
    for origin, sheets in enumerate([[(base, "")], tree.sheets]):
        for css, media in sheets:
            if not media_applies(media, width):
                continue
            for head, body in sheet_rules(css, width):
                found = list(declarations(body))
                for steps, weight in selectors(head) if found else ():
                    order += 1
                    rules.setdefault(_key(steps[0][1]), []).append((steps, (origin, 0, weight, order), found))
    root_size = 16.0
    for element in tree.elements[:most]:
        keys = [("tag", "*"), ("tag", element.tag), *(("class", c) for c in element.classes), ("id", element.attrs.get("id", ""))]
        won: dict[str, tuple] = {}

        def offer(found, place, won=won):
            for i, (name, value, important) in enumerate(found):
                rank = (important, *place, i)
                if name not in won or rank > won[name][0]:
                    won[name] = (rank, value)

        for key in keys:
            for steps, place, found in rules.get(key, ()):
                if matches(element, steps):
                    offer(found, place)
        if "style" in element.attrs:
            offer(list(declarations(element.attrs["style"])), (1, 1, (0, 0, 0), 0))
        element.style = _computed(element, {name: value for name, (_, value) in won.items()}, root_size)
        if element is tree.html:
            root_size = element.style["font-size"]
    return tree.elements[:most]


def page_styles(html: str | None, base: str, width: int, most: int | None, most_fonts: int | None) -> list[dict]:
    """Observations of one page: colours (text, background, border) and fonts with their counts, in order of the first one."""
    every = cascade(html, base, width, None)
    seen: dict[tuple, dict] = {}

    def count(kind: str, tag: str | None = None, **values) -> None:
        one = seen.setdefault((kind, *values.values()), {"kind": kind, **values, "tag": tag, "cnt": 0, "ord": len(seen)})
        one["cnt"] += 1

    for element in every[:most]:
        style = element.style
        for value in (style["color"], style["background-color"], _border(style)):
            if value != CLEAR:
                count("color", value=value)
    for element in [e for e in every if e.tag in FONT_TAGS][:most_fonts]:
        style = element.style
        size = f"{round(style['font-size'], 4):g}px"
        count("font", element.tag.upper(), family=style["font-family"], size=size, weight=str(style["font-weight"]))
    return list(seen.values())
