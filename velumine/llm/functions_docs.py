"""Functions paired with their documentation (problem 2).

One parsing-expression grammar per language walks a source text. Comments and strings are consumed as such, so code in them
defines nothing. Semantic actions pair a definition with the documentation that the language attaches to it and keep source
offsets; the description is then filtered for informativeness.

Null and empty texts, and texts in other languages, give no pairs. Several clauses of one name are one function, described by
its first real documentation. Mixed line ends are read as line feeds.
"""

from __future__ import annotations

import re
import textwrap
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velumine.functions.text import key, level
from velumine.llm.peg import End, Expr, Nested, Rule, act, alt, extent, many, maybe, parse, seq, take, tok
from velumine.session import spread

EXTENSIONS = {"ex": "elixir", "exs": "elixir", "py": "python", "pyi": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "go": "go", "rs": "rust"}


class Doc(NamedTuple):
    text: str


class Name(NamedTuple):
    text: str
    at: int  # offset of the definition


class Pair(NamedTuple):
    name: str
    doc: str
    start: int
    end: int


def _pair(values: list, start: int, end: int) -> list:
    """The last documentation before a definition belongs to it."""
    docs = [v.text for v in values if isinstance(v, Doc)]
    name = next((v for v in values if isinstance(v, Name)), None)
    return [Pair(name.text, docs[-1], name.at, _end(values, end))] if docs and name else []


def _end(values: list, end: int) -> int:
    return max([end, *(v.at for v in values if isinstance(v, End))])


def _name(m: re.Match[str]) -> Name:
    return Name(m.group("n"), m.start())


def _none(values: list, start: int, end: int) -> list:
    return []


# Elixir. A doc of no text (false, options) leaves an earlier one standing only if it gives options.
def _elixir() -> Expr:
    body = r'"""(?P<a>.*?)"""|\'\'\'(?P<b>.*?)\'\'\'|"(?P<c>(?:[^"\\]|\\.)*)"'
    sigil = r"~[sS](?:" + r'"""(?P<d>.*?)"""|\'\'\'(?P<e>.*?)\'\'\'|"(?P<f>(?:[^"\\]|\\.)*)"|\((?P<g>[^)]*)\)|\[(?P<h>[^\]]*)\]|\{(?P<i>[^}]*)\}|\|(?P<j>[^|]*)\||/(?P<k>[^/]*)/|<(?P<l>[^>]*)>|\'(?P<m>[^\']*)\')'
    doc = take(r"^[ \t]*@doc[ \t(]+(?:" + body + "|" + sigil + r")\)?", lambda m: Doc(next((g for g in m.groups() if g is not None), "")), re.M | re.S)
    off = take(r"^[ \t]*@doc[ \t(]+(?:false|nil)\b[^\n]*", lambda m: Doc(""))
    string = tok(r'"""(?:[^"\\]|\\.|"(?!""))*"""|\'\'\'.*?\'\'\'|"(?:[^"\\]|\\.)*"|~[a-zA-Z]+(?:"""(?:.*?)"""|\'\'\'.*?\'\'\'|"(?:[^"\\]|\\.)*"|\((?:[^)\\]|\\.)*\)|\[(?:[^\]\\]|\\.)*\]|\{(?:[^}\\]|\\.)*\}|\|(?:[^|\\]|\\.)*\||/(?:[^/\\]|\\.)*/|<(?:[^>\\]|\\.)*>)', re.M | re.S)
    comment = tok(r"#[^\n]*")
    space = tok(r"[^\S\n]*\n|[^\S\n]+(?=#)")
    # The value of an attribute may go on over lines inside brackets or with an indentation.
    attribute = tok(r"^[ \t]*@(?!doc\b|moduledoc\b|typedoc\b)[a-z_]\w*[?!]?(?:\"(?:[^\"\\]|\\.)*\"|[^\n\"])*(?:\n[ \t]+(?:\||\w[^\n]*::|when\b)[^\n]*)*")
    options = tok(r"^[ \t]*@doc[ \t(]+(?:\[|\w+:)[^\n]*")
    define = take(r"^[ \t]*(?:def|defp|defmacro|defmacrop|defguard|defguardp|defdelegate)[ \t(]+(?P<n>(?!unquote\b)[a-z_]\w*[?!]?)", _name)
    between = alt(doc, off, options, attribute, comment, space)
    # A body is a line of ``do:``, or goes from ``do`` to its ``end``; ``fn`` and inner blocks have their own.
    plain = alt(string, comment, tok(r"\?\\?.|:\w+|\w+:(?!:)|\w+(?:\.\w+)*[?!]?"), tok(r"[^\w\"'#~?:]+"), tok(r"(?!\bend\b).", re.S))
    block = Nested(r"\b(?:do|fn)\b(?!:)", r"\bend\b", plain, open_end=True)
    header = many(seq(tok(r"(?!\bdo\b(?!:))(?!\n[ \t]*(?:def|@|end\b))"), alt(string, comment, tok(r"\?\\?.|:\w+|\w+:(?!:)|\w+(?:\.\w+)*[?!]?"), tok(r"[^\w\"'#~?:\n]+"), tok(r"(?<=[,\\|>=(\[{])[ \t]*\n|\n(?=[ \t]*(?:when|do:|\|>|,|\)|\||do\b))"), tok(r"[^\n\w]"))))
    body_end = extent(seq(header, maybe(block)))
    documented = Rule("documented")
    documented.body = act(seq(alt(doc, off), many(between), define, body_end), _pair)
    skip = tok(r"(?:[^\"'#~?@\n]|\?\\?.|[~?@](?!\w)|~(?=\W)|@|\n(?![ \t]*@doc)|'(?!''))", re.M)
    words = tok(r"[^\"'#~?@\n]+|\n(?![ \t]*@doc)(?:[^\"'#~?@\n])*")
    return many(alt(documented, string, comment, words, skip, tok(r".", re.S)))


_PY_STRING = r'[rRbBuUfF]{0,2}(?:"""(?:[^"\\]|\\.|"(?!""))*"""|\'\'\'(?:[^\'\\]|\\.|\'(?!\'\'))*\'\'\'|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\')'


_INDENT = re.compile(r"[ \t]*")
_PY_LINE = re.compile(r"(?:\n[ \t]*(?:#[^\n]*)?(?=\n))*\n([ \t]*)(?=[^\s])")


def _python() -> Expr:
    string = tok(r"(?<!\w)" + _PY_STRING + "|" + _PY_STRING, re.S)
    comment = tok(r"#[^\n]*")
    plain = tok(r"[^()\[\]{}\"'#]+")
    bracket = Nested(r"[(\[{]", r"[)\]}]", alt(string, comment, plain, tok(r"[\"'#]")))
    head = take(r"^[ \t]*(?:async[ \t]+)?def[ \t]+(?P<n>[^\W\d]\w*)\s*", _name)
    generic = maybe(seq(tok(r"(?=\[)"), bracket, tok(r"\s*")))
    result = maybe(seq(tok(r"\s*->\s*"), many(alt(bracket, string, tok(r"[^()\[\]{}\"'#:\n]+")))))
    trivia = many(alt(tok(r"\s+"), comment))
    text = take(
        r'(?:[rRuU]?)(?:"""(?P<a>(?:[^"\\]|\\.|"(?!""))*)"""|\'\'\'(?P<b>(?:[^\'\\]|\\.|\'(?!\'\'))*)\'\'\'|"(?P<c>(?:[^"\\\n]|\\.)*)"|\'(?P<d>(?:[^\'\\\n]|\\.)*)\')(?=[ \t]*(?:#[^\n]*)?(?:;|\n|\Z))',
        lambda m: Doc(next((g for g in m.groups() if g is not None), "")),
        re.S,
    )
    documented = Rule("documented")

    def pair(values: list, start: int, end: int) -> list:
        return [Pair(values[0].text, values[1].text, values[0].at, _end(values, end))]

    inside_line = many(alt(bracket, string, comment, tok(r"\\\\\n|[^()\[\]{}\"'#\n]+"), tok(r"[^\n]")))

    def suite(source: str, at: int, memo: dict) -> tuple[int, list] | None:
        """Lines that are indented deeper than the line of ``def``, in which strings and brackets may go on over lines."""
        first = source.rfind("\n", 0, at) + 1
        depth = _INDENT.match(source, first).end() - first
        end = inside_line(source, at, memo)[0]
        while (m := _PY_LINE.match(source, end)) and len(m.group(1)) > depth:
            end = inside_line(source, m.end(), memo)[0]
        return end, []

    documented.body = act(seq(extent(suite), head, generic, bracket, result, tok(r"\s*:"), trivia, text), lambda v, a, z: pair([x for x in v if not isinstance(x, End)] + [x for x in v if isinstance(x, End)], a, z))
    line = tok(r"\n(?:[ \t]*\n)*(?![ \t]*(?:async[ \t]+)?def\b)[^\"'#\n]*|[^\"'#\n]+")
    return many(alt(documented, string, comment, line, tok(r".", re.S)))


_JS_STRING = r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|`(?:[^`\\]|\\.)*`'
_JS_WORD = r"(?!(?:if|for|while|switch|catch|return|function|with|super|do|else|new|typeof|await|throw|class|import|export|const|let|var|case|delete|void|yield)\b)[\w$]+"


def _javascript() -> Expr:
    string = tok(_JS_STRING, re.S)
    block = tok(r"/\*.*?(?:\*/|\Z)", re.S)
    line = tok(r"//[^\n]*")
    space = tok(r"\s+")
    doc = take(r"/\*\*(?![*/])(?P<t>.*?)\*/", lambda m: Doc(re.sub(r"^[ \t]*\*+ ?", "", m.group("t"), flags=re.M)), re.S)
    paren = Nested(r"\(", r"\)", alt(string, block, line, tok(r"[^()\"'`/]+"), tok(r"/")))
    function = take(r"(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(?P<n>[\w$]+)(?=\s*[(<])", _name)
    value = take(r"(?:export\s+)?(?:(?:const|let|var|static|readonly)\s+)*(?:[\w$]+\.)*(?P<n>#?" + _JS_WORD + r")\s*[=:]\s*(?:async\s*)?(?=function\b|\(|[\w$]+\s*=>)", _name)
    arrow = alt(tok(r"function\b"), seq(paren, tok(r"\s*(?::[^={]+)?=>")), tok(r"[\w$]+\s*=>"))
    method = take(r"(?:(?:static|async|get|set|public|private|protected|override)\s+(?![(=]))*\*?\s*#?(?P<n>" + _JS_WORD + r")\s*(?=\()", _name)
    braces = Nested(r"\{", r"\}", alt(string, block, line, tok(r"[^{}\"'`/]+"), tok(r"[/\"'`]")), open_end=True)
    # The body is the first block behind the head, or what an arrow gives up to the end of its line.
    body = seq(many(alt(paren, string, block, line, tok(r"[^{}()\"'`/;\n]+"), tok(r"(?<=[=>,(|&?:+])\s*\n|\n(?=\s*[{.?:=])"), tok(r"/"))), maybe(braces))
    define = alt(seq(function, extent(body)), seq(value, arrow, extent(body)), seq(method, extent(body), paren, tok(r"\s*(?::[^{;]+)?\{")))
    documented = Rule("documented")
    decorator = seq(tok(r"@[\w$.]+"), maybe(paren))
    documented.body = act(seq(doc, many(alt(space, doc, block, line, decorator)), define), _pair)
    words = tok(r"[^/\"'`]+")
    return many(alt(documented, string, block, line, words, tok(r".", re.S)))


def _rust() -> Expr:
    string = tok(r'b?r(?P<h>#*)".*?"(?P=h)|b?"(?:[^"\\]|\\.)*"|b?\'(?:[^\'\\\n]|\\(?:u\{[^}]*\}|x..|.))\'', re.S)
    doc = take(r"///(?!/)[^\n]*(?:\n[ \t]*///(?!/)[^\n]*)*", lambda m: Doc(re.sub(r"^[ \t]*/// ?", "", m.group(), flags=re.M)))
    line = tok(r"//(?!/(?!/))[^\n]*")
    block = Nested(r"/\*", r"\*/", tok(r"(?:[^*/]|\*(?!/)|/(?!\*))+"), open_end=True)
    bracket = Nested(r"\[", r"\]", alt(string, tok(r"[^\[\]\"]+"), tok(r"\"")))
    attribute = seq(tok(r"#!?\s*"), bracket)
    define = take(r"(?:pub(?:\s*\([^)]*\))?\s+)?(?:default\s+)?(?:const\s+)?(?:async\s+)?(?:unsafe\s+)?(?:extern\s+(?:\"[^\"]*\"\s+)?)?fn\s+(?:r#)?(?P<n>\w+)", _name)
    documented = Rule("documented")

    def join(values: list, start: int, end: int) -> list:
        docs = [v.text for v in values if isinstance(v, Doc)]
        name = next(v for v in values if isinstance(v, Name))
        return [Pair(name.text, "\n".join(docs), name.at, _end(values, end))]

    comment = tok(r"//[^\n]*")
    braces = Nested(r"\{", r"\}", alt(string, comment, block, tok(r"[^{}\"'/]+"), tok(r"['/\"]")), open_end=True)
    rest = extent(seq(many(alt(string, comment, block, tok(r"[^{};\"'/]+"), tok(r"['/]"))), maybe(braces)))
    documented.body = act(seq(doc, many(alt(tok(r"\s+"), doc, line, block, attribute)), define, rest), join)
    words = tok(r"(?:[^/\"'br]|(?<=\w)[br]|[br](?![#\"'r])|'(?=[a-z_]\w*[^'\w]))+")
    return many(alt(documented, string, line, act(doc, _none), block, words, tok(r".", re.S)))


def _go() -> Expr:
    string = tok(r"`[^`]*`|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)+'", re.S)

    def strip(m: re.Match[str]) -> Doc:
        out = []
        for part in re.findall(r"/\*.*?\*/|//[^\n]*", m.group("c"), re.S):
            if part.startswith("//"):
                if not re.match(r"//(?:[a-z0-9]+:[a-z0-9]|line |export |extern )", part):
                    out.append(part[2:].removeprefix(" "))
            else:
                out.append(re.sub(r"^[ \t]*\*+ ?", "", part[2:-2], flags=re.M))
        return Doc("\n".join(out))

    comment = take(r"^(?P<c>(?:[ \t]*(?://[^\n]*|/\*(?:[^*]|\*(?!/))*\*/[ \t]*)\n)+)", strip, re.M | re.S)
    define = take(r"func\s+(?:\([^)]*\)\s*)?(?P<n>[^\W\d]\w*)\s*[(\[]", _name)
    documented = Rule("documented")
    gap = alt(tok(r"//[^\n]*"), tok(r"/\*.*?(?:\*/|\Z)", re.S), string)
    braces = Nested(r"\{", r"\}", alt(gap, tok(r"[^{}\"'`/]+"), tok(r"['/\"`]")), open_end=True)
    # ``interface{}`` and ``struct{}`` in a head have braces of their own.
    rest = extent(seq(many(alt(gap, seq(tok(r"(?:interface|struct)\s*(?=\{)"), braces), tok(r"(?!(?:interface|struct)\s*\{)[^{}\"'`/\n]"), tok(r"(?<=[(,])\s*\n|\n(?=\s*\))"), tok(r"/"))), maybe(braces)))
    documented.body = act(seq(comment, tok(r"[ \t]*"), define, rest), _pair)
    other = alt(tok(r"//[^\n]*"), tok(r"/\*.*?(?:\*/|\Z)", re.S))
    words = tok(r"[^/\"'`\n]+|\n(?![ \t]*/)")
    return many(alt(documented, string, other, words, tok(r".", re.S)))


GRAMMARS: dict[str, Expr] = {"elixir": _elixir(), "python": _python(), "javascript": _javascript(), "rust": _rust(), "go": _go()}
#: What a text must hold to have any documentation; the rest need not be parsed.
_MARKS = {"elixir": re.compile("@doc"), "python": re.compile(r"\bdef\b[^\"']*[\"']"), "javascript": re.compile(r"/\*\*"), "rust": re.compile("///"), "go": re.compile(r"(?://|\*/)[^\n]*\n[ \t]*func\b")}

_WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
_SECTION = re.compile(
    r"^[ \t]*(?:[@\\](?!todo\b|description\b|desc\b|summary\b)[A-Za-z]+\b|:(?:param|parameter|arg|argument|type|return|returns|rtype|raise|raises|yield|yields|var)\b[^\n]*?:"
    r"|#{1,6}[ \t]*(?:arguments?|args|parameters?|params|options?|returns?|return values?|results?|panics?|errors?|safety|examples?|usage|raises|throws|notes?|see also)\b"
    r"|\**(?:args|arguments|parameters|params|keyword args|keyword arguments|other parameters|returns?|results?|yields?|raises|throws|panics?|errors|examples?|usage|see also|notes?|attributes|options)\**[ \t]*:"
    r"|(?:parameters|returns|yields|raises|examples?|notes|see also|attributes)[ \t]*\n[ \t]*-{3,}"
    r"|>>>|iex(?:\(\d+\))?>|```)",
    re.I | re.M,
)
#: Words without information of their own: articles, pronouns, auxiliaries, prepositions, conjunctions.
_CLOSED = frozenset(
    "a an the this that these those it its they them their there here i me my we us our you your he she one ones some any each every all both "
    "is are be been being was were am do does did done has have had having can could may might must shall should will would ought "
    "of to for in on at by with from into onto about above below under over as than then so if or and but nor not no none nothing only just also too very "
    "somebody someone something anybody anyone anything nobody who whom whose which what when where why how once until till while before after yet still again now "
    "up out off far good proper properly better real please s t".split()
)
#: What speaks of documentation: by its name, by what one does to make it, or by a mark that it is missing.
_NAMED = frozenset("documentation documentations docs doc docstring docstrings documenting undocumented".split())
_SAID = frozenset("description descriptions describe describes described comment comments explanation explain explained documented written".split())
_MARK = frozenset("todo tbd tba tbc tk wip fixme xxx lorem placeholder stub dummy nan".split())
#: What says that something is absent, unfinished or to come, or is about to be made.
_STATE = frozenset(
    "missing absent lacking lacks lack empty blank pending incomplete unfinished available unavailable coming come comes came arrive arrives arrived arriving follow follows following "
    "later soon shortly eventually someday tomorrow future way time day need needs needed require requires required await awaits awaiting wait waiting "
    "add added adding write writes written writing fill filled provide provided supply supplied put go goes going get gets finish finished complete completed progress work construction know knows known hack update updated next ipsum dolor "
    "function functions method methods code text".split()
)
#: What makes documentation that is not named one to come.
_TO_COME = frozenset("no not none nothing yet here someone somebody anyone please once until should must ought shall will missing absent pending later soon shortly eventually someday tomorrow need needs needed required await awaits awaiting empty available".split())
#: Verbs that begin a description of what a function does, whatever it does it to.
_DOES = re.compile(r"(?!(?:needs|lacks|requires|awaits|follows|comes|goes|docs|descriptions|comments|is|was|has|does|this|its|tests)\b)[a-z]{2,}[^\Wsu]s\Z")
_ARTICLES = frozenset("a an the function functions method methods fn func def this that of it its is to".split())


def description(doc: str, name: str, language: str) -> str:
    """The description in a documentation: without sections, tags and, in Go, the function's own name in front."""
    text = textwrap.dedent(doc.expandtabs(2)).strip()
    m = _SECTION.search(text)
    if m:
        text = text[: m.start()].rstrip()
    text = re.sub(r"^[ \t]*[@\\](?:description|desc|summary)\b", "", text, flags=re.M)
    if language == "go":
        text = re.sub(rf"\A\s*{re.escape(name)}\b[ \t]*", "", text)
    return text.strip()


_ENDINGS = ("", "s", "es", "ed", "d", "ing", "er", "or", "ers", "ors", "ion", "ions", "ation", "ations", "ment", "ly", "able")


def _roots(word: str) -> set[str]:
    """What ``word`` may be an inflection of."""
    w, out = word.lower(), set()
    for end in _ENDINGS:
        if not w.endswith(end) or len(w) - len(end) < min(3, len(w)):
            continue
        root = w[: len(w) - len(end)]
        out.add(root)
        if root.endswith("i"):
            out.add(root[:-1] + "y")
        if len(root) > 3 and root[-1] == root[-2]:
            out.add(root[:-1])
        if len(root) > 3 and root.endswith("e"):
            out.add(root[:-1])
    return out


def _parts(text: str) -> list[str]:
    return re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[^\W\dA-Za-z_]+", text)


def _name_roots(name: str) -> set[str]:
    parts = _parts(name)
    return set().union(*map(_roots, parts), _roots("".join(parts)), _roots(name))


def information(words: list[str]) -> list[str]:
    """The words that say more than that a description is there, missing or to come."""
    return [w for w in words if len(w) > 1 and w not in _CLOSED and w not in _NAMED and w not in _SAID and w not in _MARK and w not in _STATE]


def _says_missing(low: list[str]) -> bool:
    """Whether words only say that documentation is missing or to come: they speak of documentation, or are marked as left
    out, and say at most one thing besides. A verb at the head says what the function does and has documentation as its
    object at most."""
    words = set(low)
    if _DOES.match(low[0]):
        return False
    more = len(information(low))
    if words & _MARK or words & _NAMED:
        return more <= 1
    return more == 0 and bool(words & _SAID) and (bool(words & _TO_COME) or low[:2] == ["to", "be"])


def trivial(text: str, name: str) -> bool:
    """Whether a description says nothing: fewer than four words, only that it is missing, or only the name again."""
    words = _WORD.findall(text)
    if len(words) < 4:
        return True
    low = [w.lower() for w in words]
    if _says_missing(low):
        return True
    own = _name_roots(name)
    return all(p.lower() in _ARTICLES or not own.isdisjoint(_roots(p)) for w in words for p in _parts(w))


def _code(text: str, start: int, end: int) -> str:
    """The definition from its first line to the end of its body, as the grammar found it."""
    first = text.rfind("\n", 0, start) + 1
    return textwrap.dedent(text[first:end]).rstrip()


def documented(source: str | None, language: str | None) -> list[tuple[str, str, str, int]]:
    """(name, description, code, offset) of each function of ``source`` that has real documentation."""
    if not source or language not in GRAMMARS:
        return []
    text = source.replace("\r\n", "\n").replace("\r", "\n")
    if not _MARKS[language].search(text):
        return []
    out: dict[str, tuple[str, str, str, int]] = {}
    for pair in parse(GRAMMARS[language], text):
        if pair.name in out:
            continue
        said = description(pair.doc, pair.name, language)
        if not trivial(said, pair.name):
            out[pair.name] = (pair.name, said, _code(text, pair.start, pair.end), pair.start)
    return list(out.values())


def document_pairs(nodes: DataFrame) -> DataFrame:
    """(node_id, func_name, language, description, code) for nodes of type function, method, module and class.

    The language of a node without one follows from the extension of its file. A node in several rows counts once.
    """
    extension = F.lower(F.regexp_extract(F.trim("file_path"), r"\.([A-Za-z]+)$", 1))
    by_extension = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    language = F.coalesce(F.nullif(level("language"), F.lit("")), F.try_element_at(by_extension, extension))
    source = spread(nodes.select(key("id").alias("node_id"), language.alias("_l"), F.col("source_text").alias("_t"), level("type").alias("_k")))
    source = source.filter(F.col("_k").isin("function", "method", "module", "class") & F.col("_t").isNotNull()).select("node_id", "_l", "_t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["node_id", "func_name", "language", "description", "code"]
        for b in batches:
            rows = []
            for node, lang, text in zip(*(c.to_pylist() for c in b.columns)):
                rows += [(node, n, lang, d, c) for n, d, c, _ in documented(text, lang)]
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=names)

    pairs = source.mapInArrow(run, "node_id string, func_name string, language string, description string, code string")
    return pairs.dropDuplicates(["node_id", "func_name"])
