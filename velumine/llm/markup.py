"""Markup residue in texts (problem 5).

``analyse`` reads a text once and returns the kinds of markup in it and its clean text. Code (fenced blocks, inline code,
HTML ``pre``, LaTeX ``verbatim``) is taken out first, since what stands in it is content. HTML is the event stream of the
standard library's parser: its events of tags, comments, doctype and character references say whether a text has HTML, and
its data events are the text; what the parser takes for a tag but no element of HTML is text too. Then LaTeX, wiki and
Markdown constructs are converted in turn. Headings become ``#`` lines, lists ``-`` and ``1.`` lines, code fenced blocks,
formulas ``$`` spans.

In whole HTML pages (a doctype, ``html`` or ``body`` anywhere) lines are weighed by their text-to-tag ratio, where the text of
links does not count, smoothed by a Gaussian, and split in two clusters by a threshold. Lines form regions: a list, a table, a
heading with what follows, a run of other lines. A region of the low cluster that is made of links, or stands in ``nav``,
``header``, ``footer``, ``aside`` or ``form``, is left out as a whole: menus, also those that are lists, and footers.

Null and empty texts have no kinds and an empty clean text.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velumine.functions.text import key, level
from velumine.session import spread

KINDS = ("html", "markdown", "wiki", "latex")

#: The element names of HTML.
_ELEMENTS = (
    "a abbr acronym address area article aside audio b base bdi bdo big blockquote body br button canvas caption center cite "
    "code col colgroup data datalist dd del details dfn dialog dir div dl dt em embed fieldset figcaption figure font footer "
    "form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html i iframe img input ins kbd label legend li link main map "
    "mark menu meta meter nav noframes noscript object ol optgroup option output p param picture pre progress q rp rt ruby s "
    "samp script search section select slot small source span strike strong style sub summary sup svg table tbody td template "
    "textarea tfoot th thead time title tr track tt u ul var video wbr nowiki ref references gallery math"
)
_NAMES = frozenset(_ELEMENTS.split())
#: What cannot begin markup: a mark of comparison, or one that nothing closes.
_BARE = re.compile(r"<(?!(?:/?[A-Za-z]|!--|!\[CDATA\[|![A-Za-z]|\?))|<(?!!--|[^<>]*>|[^<>]*<[^<>]*>[^<>]*[\"'][^<>]*>)")
#: The shape of a tag, by its raw text: a name, attributes, perhaps a slash.
_SHAPE = re.compile(r"</?[A-Za-z][A-Za-z0-9]*(?:\s+[^<>\s=/\"']+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s<>\"']+))?)*\s*/?>\Z")
#: Elements whose text is rarely content.
_ASIDE = frozenset("nav header footer aside form".split())
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")

# Code of all kinds; the earliest opening wins, so that nothing inside one kind opens another.
_CODE = re.compile(
    r"(?P<fence>^[ \t]*(?:>[ \t]?)*(?P<mark>`{3,}|~{3,})(?P<info>[^`\n]*)\n(?P<body>.*?)(?:^[ \t]*(?:>[ \t]?)*(?P=mark)[`~]*[ \t]*$|\Z))"
    r"|(?P<pre><pre\b[^>]*>(?P<pbody>.*?)(?:</pre\s*>|\Z))"
    r"|(?P<verb>\\begin\{(?P<env>verbatim\*?|lstlisting|minted)\}(?P<vbody>.*?)(?:\\end\{(?P=env)\}|\Z))"
    r"|(?P<script><(?P<raw>script|style)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z))"
    r"|(?P<inline>(?<![`\\])(?P<tick>`{1,2})(?!`)(?P<ibody>[^\n]*?[^`\n])(?P=tick)(?!`))",
    re.S | re.M | re.I,
)

_FORMULA = re.compile(
    r"\$\$(?P<d>.+?)\$\$|\\\[(?P<b>.+?)\\\]|\\\((?P<p>.+?)\\\)"
    r"|(?<![\\$\w])\$(?P<i>(?=[^$\n]*[A-Za-z\\^_={}])[^\s$](?:[^$\n]*?[^\s$\\])?)\$(?![\d$\w])",
    re.S,
)
_COMMAND = re.compile(r"(?:(?<![\w:\\.\]])|(?<!:)(?=\\[A-Za-z]+\*?[\[{]))\\(?P<name>[A-Za-z]{2,})\*?(?P<opt>\[[^\]\n]*\])?(?P<arg>\{(?:[^{}]|\{[^{}]*\})*\})?|\\[\"'`^~=.uvHcdbtr](?:\{(?P<acc>\\?[A-Za-z])\}|(?<=[\"'`^~=.])(?P<acc2>[A-Za-z]))|(?<=[\s{&])\\\\(?=\s*$)|\\[&%#_{}](?=[^\w\\]|\d)", re.M)
_ENVIRONMENT = re.compile(r"\\(begin|end)\{([A-Za-z]+\*?)\}")
_MATH_ENV = re.compile(r"\\begin\{(equation|align|gather|multline|displaymath|math|eqnarray)(\*?)\}(?P<m>.*?)\\end\{\1\2\}", re.S)

_WIKI_TABLE = re.compile(r"^[ \t]*\{\|.*?(?:^[ \t]*\|\}|\Z)", re.S | re.M)
_WIKI_ROW = re.compile(r"^[ \t]*(?:\{\|[^\n]*|\|\}|\|-[^\n|]*|\|\+[^\n]*|\|[^\n|]+\|\|[^\n]+|![^\n!]+!![^\n]+)$", re.M)
_TEMPLATE_OPEN = re.compile(r"\{\{(?=[A-Za-z#:][^{}\n]*(?:\n|\Z|\|))")
_WIKI_LINK = re.compile(r"\[\[([^\[\]\n|]+)(?:\|([^\[\]\n]*))?\]\]")
_WIKI_EXTERNAL = re.compile(r"(?<![\]\w\[])\[(?:https?|ftp)://[^\s\]]+(?:[ \t]+([^\]\n]+))?\](?![\[(:])")
_WIKI_QUOTES = re.compile(r"(?<![\w'])('{2,5})(?=[^\s'])([^\n]*?[^\s'])\1(?!')")
_WIKI_HEADING = re.compile(r"^[ \t]*(={1,6})[ \t]*(?P<t>[^=\s](?:[^\n]*?[^=\s])?)[ \t]*\1[ \t]*$", re.M)
_WIKI_ITEM = re.compile(r"^[ \t]*(?P<m>[*#:;]+)[ \t]*(?P<t>[^\n]*\[\[[^\n]*)$", re.M)

_MD_HEADING = re.compile(r"^ {0,3}(?P<h>#{1,6})[ \t]+(?=\S)(?!\d)(?P<t>[^\n]*?)[ \t]*#*[ \t]*$", re.M)
_MD_UNDERLINE = re.compile(r"^(?P<t>[^\n|>]*\w[^\n|]*)\n {0,3}(?P<u>={3,}|-{3,})[ \t]*$", re.M)
_MD_BULLET = re.compile(r"^(?P<i>[ \t]*)[-*+][ \t]+(?P<b>\[[ xX]\][ \t]+)?(?P<t>\S[^\n]*)$", re.M)
_MD_NUMBER = re.compile(r"^(?P<i>[ \t]*)(?P<n>\d{1,9})[.)][ \t]+(?P<t>\S[^\n]*)$", re.M)
_MD_QUOTE = re.compile(r"^[ \t]{0,3}(?:>[ \t]?)+(?![=\d])(?P<t>[^\n]*\w[^\n]*)$", re.M)
_MD_RULE = re.compile(r"^[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)+\|?[ \t]*$", re.M)
_MD_ROW = re.compile(r"^[ \t]*\|(?!\|)[^\n|]*(?<!\|)\|(?!\|)[^\n]*\|[ \t]*$", re.M)
_MD_IMAGE = re.compile(r"!\[([^\]\n]*)\](?:\([^)\n]*\)|\[[^\]\n]*\])")
_MD_LINK = re.compile(r"(?<![\w\]!\[])\[([^\[\]\n]+)\]\([^()\s]*(?:\([^()\s]*\)[^()\s]*)?(?:[ \t]+[\"'][^\n]*?[\"'])?\)")
_MD_REFLINK = re.compile(r"(?<![\w\]!\[])\[([^\[\]\n]+)\]\[[^\[\]\n]*\](?![\[\w])")
_MD_DEFINITION = re.compile(r"^ {0,3}\[[^\]\n]+\]:[ \t]+\S[^\n]*$", re.M)
_MD_FOOTNOTE = re.compile(r"\[\^[^\]\s]+\](?::[ \t]*)?")
_MD_AUTOLINK = re.compile(r"<((?:https?|ftp|mailto):[^\s<>]+|[\w.+-]+@[\w-]+\.[\w.-]+)>")
_MD_MARKS = (
    re.compile(r"(?<![*\w\\])(\*{1,3})(?=[^\s*])([^\n*]*?[^\s*\\])\1(?![*\w])"),
    re.compile(r"(?<![_\w\\])(_{1,3})(?=[^\s_])((?:[^\n_]|(?<=\w)_(?=\w))*?[^\s_\\])\1(?![_\w])"),
    re.compile(r"(?<![~\w])(~~)(?=[^\s~])([^\n~]*?[^\s~])\1(?![~\w])"),
)
_DUNDER = re.compile(r"[a-z0-9]+(?:_[a-z0-9]+)*\Z")
_SECTIONS = {"part": 1, "chapter": 1, "title": 1, "section": 2, "subsection": 3, "subsubsection": 4, "paragraph": 5}
_SILENT = {"documentclass", "usepackage", "label", "ref", "eqref", "cite", "citep", "citet", "maketitle", "bibliography", "bibliographystyle", "vspace", "hspace", "includegraphics", "centering", "hline", "tableofcontents", "newpage", "date", "input", "include", "pagestyle", "noindent"}
_HOLD = re.compile("\x00(\\d+)\x00")


#: Elements that stand in a head; any other one, and text outside these, ends it.
_IN_HEAD = frozenset("html head title meta link base style script noscript template".split())


# Marks in the reader's output: a tag, an own line, a link's begin and end, a place besides the content and its end.
_TAG, _OWN, _LINK, _UNLINK, _OFF, _ON = "\x01", "\x03", "\x04", "\x05", "\x06", "\x0e"
# Marks in its input: an ampersand and a less-than sign that are text.
_AMPERSAND, _LESS = "\x0f", "\x10"
_NO_MARKS = dict.fromkeys([0, 1, 2, 3, 4, 5, 6, 14, 15, 16])
_STRIP = dict.fromkeys(map(ord, _TAG + _LINK + _UNLINK + _OFF + _ON))


class _Reader(HTMLParser):
    """Turns the parser's events into Markdown-like lines, counting text and tags of each line."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)
        self.parts: list[str] = []
        self.lists: list[list] = []
        self.table = 0
        self.skip = False
        self.inside = ""  # the element of the head that is open
        self.head: list[str] = []  # text of the head, for a head that is cut off
        self.found = False  # any markup
        self.page = False  # a whole page
        self.raw_end = ""

    def _end_head(self) -> None:
        self.skip, self.inside, self.head = False, "", []

    def close(self) -> None:
        super().close()
        if self.skip:
            self.parts += self.head
            self._end_head()

    def _block(self) -> None:
        self.parts.append("\n")

    def parse_endtag(self, i: int) -> int:
        end = self.rawdata.find(">", i)
        self.raw_end = self.rawdata[i : end + 1]
        return super().parse_endtag(i)

    def parse_bogus_comment(self, i: int, report: int = 1) -> int:
        end = self.rawdata.find(">", i + 2)
        if end < 0:
            return -1
        self.handle_data(self.rawdata[i : end + 1])
        return end + 1

    def handle_comment(self, data: str) -> None:
        self.found = True

    def handle_decl(self, decl: str) -> None:
        if decl[:7].lower() == "doctype":
            self.found = self.page = True
        else:
            self.handle_data(f"<!{decl}>")

    def unknown_decl(self, data: str) -> None:
        self.found = True
        if data.startswith("CDATA["):
            self.handle_data(data[6:])

    def handle_entityref(self, name: str) -> None:
        self.found = True
        self.handle_data(html.unescape(f"&{name};"))

    def handle_charref(self, name: str) -> None:
        self.found = True
        self.handle_data(html.unescape(f"&#{name};"))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        raw = self.get_starttag_text() or ""
        if tag not in _NAMES or not _SHAPE.match(raw):
            self.handle_data(raw)
            return
        self.found = True
        self.page = self.page or tag in ("html", "body")
        self.parts.append(_TAG)
        if self.skip and tag not in _IN_HEAD and self.inside not in ("noscript", "template"):
            self._end_head()
        if tag == "head":
            self.skip = True
        elif self.skip and tag in ("title", "style", "script", "noscript", "template"):
            self.inside = tag
        elif tag == "title":
            pass
        elif tag == "a":
            self.parts.append(_LINK)
        elif re.fullmatch("h[1-6]", tag):
            self.parts.append("\n" + _OWN + "#" * int(tag[1]) + " ")
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
            self._block()
        elif tag == "li":
            self._block()
            if self.lists and self.lists[-1][0] == "ol":
                self.lists[-1][1] += 1
                self.parts.append(_OWN + "  " * (len(self.lists) - 1) + f"{self.lists[-1][1]}. ")
            else:
                self.parts.append(_OWN + "  " * max(0, len(self.lists) - 1) + "- ")
        elif tag == "table":
            self.table += 1
            self._block()
        elif tag == "tr":
            self.parts.append("\n" + _OWN)
        elif tag in ("td", "th"):
            self.parts.append("| ")
        elif tag in ("p", "div", "br", "section", "article", "main", "blockquote", "hr", "dl", "dt", "dd", "figure", "body", "pre") or tag in _ASIDE:
            self._block()
            if tag in _ASIDE:
                self.parts.append(_OFF)

    def handle_endtag(self, tag: str) -> None:
        if tag not in _NAMES or not _SHAPE.match(self.raw_end):
            self.handle_data(self.raw_end)
            return
        self.found = True
        self.parts.append(_TAG)
        if tag in ("head", "body", "html"):
            self._end_head()
        elif self.skip:
            self.inside = "" if tag == self.inside else self.inside
        elif tag == "a":
            self.parts.append(_UNLINK)
        elif tag in ("ul", "ol"):
            if self.lists:
                self.lists.pop()
            self._block()
        elif tag == "table":
            self.table = max(0, self.table - 1)
            self._block()
        elif tag == "tr":
            self.parts.append("|")
        elif tag in ("td", "th"):
            self.parts.append(" ")
        elif tag in ("p", "div", "section", "article", "blockquote", "pre") or re.fullmatch("h[1-6]", tag):
            self._block()
        elif tag in _ASIDE:
            self.parts.append(_ON)
            self._block()

    def handle_data(self, data: str) -> None:
        if self.skip and not self.inside and not data.isspace():
            self._end_head()
        if self.skip and self.inside not in ("style", "script"):
            self.head.append(data)
        # White space between the tags of a list or a table is no text.
        if not self.skip and not ((self.lists or self.table) and data.isspace()):
            self.parts.append(data)


def read_html(t: str) -> _Reader:
    """The reader after the events of ``t``."""
    t = _ENTITY.sub(lambda m: m.group() if m.group()[1] == "#" or m.group()[1:] in html5 else _AMPERSAND + m.group()[1:], t)
    t = re.sub(rf"&(?!{_ENTITY.pattern[1:]})", _AMPERSAND, t)
    reader = _Reader()
    reader.feed(_BARE.sub(lambda m: _LESS + m.group()[1:], t))
    reader.close()
    return reader


def _measure(lines: list[str]) -> tuple[list[float], list[int], list[int], list[bool]]:
    """Of each line: characters outside links per tag, characters, characters in links, and whether it stands aside."""
    ratios, chars, links, aside = [], [], [], []
    link = off = 0
    for x in lines:
        n = inside = tags = 0
        was_off = off > 0
        for part in re.split("([\x01\x04\x05\x06\x0e])", x):
            if part == _TAG:
                tags += 1
            elif part == _LINK:
                link += 1
            elif part == _UNLINK:
                link = max(0, link - 1)
            elif part == _OFF:
                off += 1
                was_off = True
            elif part == _ON:
                off = max(0, off - 1)
            else:
                size = len(part.strip(" \t\x03"))
                n += size
                inside += size if link else 0
        ratios.append((n - inside) / max(1, tags))
        chars.append(n)
        links.append(inside)
        aside.append(was_off)
    return ratios, chars, links, aside


def _regions(lines: list[str]) -> list[tuple[int, int]]:
    """(first, behind the last) of the regions of ``lines``: lists, tables and runs of other lines; a heading begins one."""

    def kind(x: str) -> str:
        plain = x.translate(_STRIP)
        if not plain.startswith(_OWN):
            return "" if plain.strip() else " "
        return "#" if plain[1:2] == "#" else "|" if plain[1:2] == "|" else "-"

    out, start, last = [], 0, ""
    for i, x in enumerate(lines):
        k = kind(x)
        if k == " ":
            continue
        new = k == "#" or k != last and not (last == "#" and k)
        if new and last:
            out.append((start, i))
            start = i
        last = "" if last == "#" and not k else k
        last = last or "text"
        if k == "":
            last = "text" if last in ("", "text") else last
    return [*out, (start, len(lines))] if lines else []


def content_lines(lines: list[str], whole_page: bool, sigma: float = 1.0) -> list[str]:
    """``lines`` of a reader without the regions of low text-to-tag ratio, if it is a whole page.

    The ratio of each line is smoothed by a Gaussian of ``sigma`` lines; the threshold between the two clusters of log ratios
    is found by moving it to the mean of the cluster means until it stands.
    """
    plain = [x.translate(_STRIP) for x in lines]
    if not whole_page or len(lines) < 4:
        return plain
    ratio, chars, links, aside = _measure(lines)
    width = max(1, math.ceil(3 * sigma))
    kernel = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-width, width + 1)]
    smooth = []
    for i in range(len(ratio)):
        pairs = [(kernel[d + width], ratio[i + d]) for d in range(-width, width + 1) if 0 <= i + d < len(ratio) and chars[i + d]]
        smooth.append(math.log1p(sum(k * r for k, r in pairs) / sum(k for k, _ in pairs)) if pairs else 0.0)
    told = [s for s, n in zip(smooth, chars) if n]
    cut = sum(told) / max(1, len(told))
    for _ in range(100):
        low, high = [s for s in told if s < cut], [s for s in told if s >= cut]
        if not low or not high:
            break
        new = (sum(low) / len(low) + sum(high) / len(high)) / 2
        if abs(new - cut) < 1e-6:
            break
        cut = new
    out: list[str] = []
    for a, z in _regions(lines):
        n = sum(chars[a:z])
        mean = sum(s * c for s, c in zip(smooth[a:z], chars[a:z])) / n if n else 0.0
        besides = sum(c for c, off in zip(chars[a:z], aside[a:z]) if off)
        # A list's lines smooth each other, so the region's own ratio counts too.
        low = mean < cut or 2 * sum(links[a:z]) > n
        if n and low and (2 * sum(links[a:z]) >= n or 2 * besides >= n):
            continue
        out += plain[a:z]
    return out


def _heading(level: int, text: str) -> str:
    return "#" * min(6, level) + " " + text.strip()


def analyse(text: str | None) -> tuple[set[str], str]:
    """(kinds of markup, clean text)."""
    if not text:
        return set(), ""
    kinds: set[str] = set()
    t = text.replace("\r\n", "\n").replace("\r", "\n").translate(_NO_MARKS)
    held: list[str] = []

    def hold(s: str) -> str:
        held.append(s)
        return f"\x00{len(held) - 1}\x00"

    def code(m: re.Match[str]) -> str:
        if m.group("fence") is not None:
            kinds.add("markdown")
            return hold("```" + (m.group("info") or "").strip() + "\n" + m.group("body").rstrip("\n") + "\n```") + "\n"
        if m.group("pre") is not None:
            body = html.unescape(re.sub(r"</?code\b[^>]*>", "", m.group("pbody")))
            return "<pre>" + hold("```\n" + body.strip("\n") + "\n```") + "</pre>"
        if m.group("verb") is not None:
            kinds.add("latex")
            return "\n" + hold("```\n" + m.group("vbody").strip("\n") + "\n```") + "\n"
        if m.group("script") is not None:
            return "<script></script>"
        kinds.add("markdown")
        return hold(m.group("ibody").strip(" "))

    if "`" in t or "~~~" in t or "<" in t or "\\begin" in t:
        t = _CODE.sub(code, t)
    if "<" in t:
        t = _MD_AUTOLINK.sub(lambda m: kinds.add("markdown") or hold(m.group(1)), t)
    if "$" in t or "\\" in t:
        def formula(m: re.Match[str]) -> str:
            kinds.add("latex")
            body = next(x for x in m.groups() if x is not None).strip()
            return hold(f"$${body}$$" if m.group("i") is None and m.group("p") is None else f"${body}$")

        t = _MATH_ENV.sub(lambda m: kinds.add("latex") or hold("$$" + re.sub(r"\\label\{[^}]*\}", "", m.group("m")).strip() + "$$"), t)
        t = _FORMULA.sub(formula, t)
    if "<" in t or "&" in t:
        reader = read_html(t)
        if reader.found:
            kinds.add("html")
            t = "\n".join(content_lines("".join(reader.parts).split("\n"), reader.page)).replace(_AMPERSAND, "&").replace(_LESS, "<")
    if "\\" in t:
        t = _latex(t, kinds)
    if "[" in t or "{" in t or "''" in t or "==" in t or "|" in t or "=" in t:
        t = _wiki(t, kinds)
    t = _markdown(t, kinds)
    for i, piece in enumerate(held):  # a piece holds earlier ones only
        held[i] = _HOLD.sub(lambda m: held[int(m.group(1))] if int(m.group(1)) < i else "", piece)
    t = _HOLD.sub(lambda m: held[int(m.group(1))] if int(m.group(1)) < len(held) else "", t)
    return kinds, re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", t)).strip()


#: LaTeX accent commands and the combining characters they stand for.
_ACCENTS = {'"': "\u0308", "'": "\u0301", "`": "\u0300", "^": "\u0302", "~": "\u0303", "=": "\u0304", ".": "\u0307", "u": "\u0306", "v": "\u030c", "H": "\u030b", "c": "\u0327", "d": "\u0323", "b": "\u0331", "t": "\u0361", "r": "\u030a"}


def _accent(mark: str, letter: str) -> str:
    return unicodedata.normalize("NFC", letter.lstrip("\\") + _ACCENTS[mark])


def _latex(t: str, kinds: set[str]) -> str:
    order: list[str] = []
    numbers: list[int] = []

    def command(m: re.Match[str]) -> str:
        kinds.add("latex")
        name, arg = m.group("name"), (m.group("arg") or "")[1:-1]
        accented = m.group("acc") or m.group("acc2")
        if accented:
            return _accent(m.group()[1], accented)
        if name is None:
            return "" if m.group().startswith("\\\\") or m.group() == "\\" else m.group()[1:]
        if name in ("begin", "end"):
            env = arg.rstrip("*")
            if env in ("itemize", "enumerate", "description"):
                if name == "begin":
                    order.append(env)
                    numbers.append(0)
                elif order:
                    order.pop()
                    numbers.pop()
            return ""
        if name in _SECTIONS:
            return "\x03" + _heading(_SECTIONS[name], arg)
        if name == "item":
            tail = arg
            if order and order[-1] == "enumerate":
                numbers[-1] += 1
                return f"\x03{numbers[-1]}. {tail}"
            return "\x03- " + tail
        if name in _SILENT:
            return ""
        return arg

    return re.sub(r"(\x03(?:-|\d+\.)) +", r"\1 ", _COMMAND.sub(command, t))


def _without_templates(t: str) -> str:
    """``t`` without its templates, however deep they stand in each other. One pass: a single brace ends what is open."""
    cuts: list[tuple[int, int]] = []
    opened: list[int] = []
    for m in re.finditer(r"\{+|\}+", t):
        n = m.end() - m.start()
        if m.group()[0] == "{":
            if n % 2:
                opened.clear()
            opened += range(m.start() + n % 2, m.end(), 2)
            continue
        at = m.start()
        while opened and m.end() - at >= 2:
            start, at = opened.pop(), at + 2
            while cuts and cuts[-1][0] >= start:
                cuts.pop()
            cuts.append((start, at))
        if m.end() > at:
            opened.clear()
    out, end = [], 0
    for a, z in cuts:
        out.append(t[end:a])
        end = z
    return "".join([*out, t[end:]])


def _wiki(t: str, kinds: set[str]) -> str:
    def mark(value: str) -> str:
        kinds.add("wiki")
        return value

    if "{|" in t or "|}" in t or "|-" in t or "||" in t or "!!" in t:
        def table(m: re.Match[str]) -> str:
            rows = []
            for line in m.group().split("\n"):
                s = line.strip()
                if s[:2] in ("{|", "|}", "|-", "|+") or not s:
                    continue
                rows.append("| " + " | ".join(x.strip() for x in re.split(r"\|\||!!", s.lstrip("|!"))) + " |")
            return mark("\n".join(rows).replace("|", "\x02"))

        t = _WIKI_TABLE.sub(table, t)
        t = _WIKI_ROW.sub(lambda m: mark("" if m.group().strip()[:2] in ("{|", "|}", "|-") else m.group().replace("|", "\x02")), t)
    if "{{" in t:
        new = _without_templates(t)
        if new != t:
            t = mark(new)
        t = _TEMPLATE_OPEN.sub(lambda m: mark(""), t)
    if "[[" in t:
        t = _WIKI_ITEM.sub(lambda m: mark("\x03" + "  " * (len(m.group("m")) - 1) + ("1. " if m.group("m")[-1] == "#" else "- ") + m.group("t")), t)
        t = _WIKI_LINK.sub(lambda m: mark(m.group(2) or m.group(1)), t)
    if "[" in t:
        t = _WIKI_EXTERNAL.sub(lambda m: mark(m.group(1) or ""), t)
    if "''" in t:
        t = _WIKI_QUOTES.sub(lambda m: mark(m.group(2)), t)
    if "=" in t:
        t = _WIKI_HEADING.sub(lambda m: mark("\x03" + _heading(len(m.group(1)), m.group("t"))), t)
    return t


def _markdown(t: str, kinds: set[str]) -> str:
    """Converts Markdown. Lines that were made from other markup begin with ``\\x03`` and are left alone."""

    def mark(value: str) -> str:
        kinds.add("markdown")
        return value

    if "![" in t:
        t = _MD_IMAGE.sub(lambda m: mark(m.group(1)), t)
    if "[" in t:
        t = _MD_FOOTNOTE.sub(lambda m: mark(""), t)
        t = _MD_DEFINITION.sub(lambda m: mark(""), t)
        t = _MD_LINK.sub(lambda m: mark(m.group(1)), t)
        t = _MD_REFLINK.sub(lambda m: mark(m.group(1)), t)
    if "|" in t and (_MD_RULE.search(t) or _MD_ROW.search(t)):
        mark("")
        t = re.sub(_MD_RULE.pattern + r"\n?", "", t, flags=re.M)
    t = t.replace("\x02", "|")
    if "---" in t or "===" in t:
        t = _MD_UNDERLINE.sub(lambda m: mark(_heading(1 if m.group("u")[0] == "=" else 2, m.group("t"))), t)
    if ">" in t:
        t = _MD_QUOTE.sub(lambda m: mark("> " + m.group("t")), t)
    if "#" in t:
        t = _MD_HEADING.sub(lambda m: mark(_heading(len(m.group("h")), m.group("t"))), t)
    t = _MD_BULLET.sub(lambda m: mark(f"{m.group('i')}- {m.group('b') or ''}{m.group('t')}"), t)
    t = _MD_NUMBER.sub(lambda m: mark(f"{m.group('i')}{m.group('n')}. {m.group('t')}"), t)
    for pattern in _MD_MARKS:
        if pattern.pattern[3:].find("~") >= 0 and "~~" not in t:
            continue
        t = pattern.sub(lambda m: m.group() if m.group(1) == "__" and _DUNDER.match(m.group(2)) else mark(m.group(2)), t)
    return t.replace("\x03", "")


def analyse_items(df: DataFrame, table_name: str, id_col: str, text_col: str = "text", want_text: bool = True) -> DataFrame:
    """(table_name, item_id, kinds, clean_text) of each item with text; an item in several rows counts once."""
    source = spread(df.select(key(F.col(id_col).cast("string")).alias("item_id"), F.col(text_col).alias("_text"))).filter("_text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds, texts = [], []
            for t in b.column(1).to_pylist():
                k, clean = analyse(t)
                kinds.append([x for x in KINDS if x in k])
                texts.append(clean if want_text else None)
            name = pa.repeat(pa.scalar(table_name), len(kinds))
            yield pa.RecordBatch.from_arrays([name, b.column(0), pa.array(kinds, pa.list_(pa.string())), pa.array(texts, pa.string())], names=["table_name", "item_id", "kinds", "clean_text"])

    out = source.mapInArrow(run, "table_name string, item_id string, kinds array<string>, clean_text string")
    return out.dropDuplicates(["item_id"])


def analyse_tables(documents: DataFrame, chunks: DataFrame, want_text: bool = True) -> DataFrame:
    """``analyse_items`` of documents and of paragraph chunks."""
    paragraphs = chunks.filter(level("level") == "paragraph")
    return analyse_items(documents, "documents", "doc_id", want_text=want_text).unionByName(analyse_items(paragraphs, "chunks", "id", want_text=want_text))


def kinds_found(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(table_name, item_id, kind): one row for each item and kind of markup in it."""
    return analyse_tables(documents, chunks, want_text=False).select("table_name", "item_id", F.explode("kinds").alias("kind"))
