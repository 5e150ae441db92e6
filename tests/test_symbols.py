"""Symbols from text: declarations, their ends, and time that grows with the text only."""

import time

import pytest

from leanspan.operators.symbols import LANGUAGES, extract_symbols, symbols_of


def found(text, language):
    return [(s[0], s[1], s[3], s[4], s[7]) for s in symbols_of(text, language)]


CASES = [
    ("python", "def f(): pass", [("f", "function", 1, 1, True)]),
    ("python", "class A:\n  def b(self):\n    '''\nx\n'''\n    return (\n1)\n\n# c\nx=1", [("A", "class", 1, 7, True), ("b", "method", 2, 7, True)]),
    ("python", "async def g(a=(1,\n2)):\n\tx = 'def no(): pass'\n\ty\n# end", [("g", "function", 1, 4, True)]),
    ("python", "def f(\n  x", [("f", "function", 1, 2, False)]),
    ("javascript", "const a = 1\nfunction f() { return `${x}` }\nclass B { x = 1\n y() { if (a) { } } }", [("f", "function", 2, 2, True), ("B", "class", 3, 4, True), ("y", "method", 4, 4, True)]),
    ("typescript", "export class A<T> extends B<C> {\n  private async run<U>(x: { a: U }): Promise<void> { }\n}\n", [("A", "class", 1, 3, True), ("run", "method", 2, 2, True)]),
    ("rust", "struct A(u8);\npub struct B;\nimpl<T> X<T> for Vec<T> where T: Y { fn a<'a>(&'a self) -> char { '{' } }\nfn b() {}", [("A", "struct", 1, 1, True), ("B", "struct", 2, 2, True), ("Vec", "impl", 3, 3, True), ("a", "method", 3, 3, True), ("b", "function", 4, 4, True)]),
    ("java", "package a;\n@X(y = {1})\npublic class A {\n  /* { */\n  @Override public <T> List<T> f(int a) { for (;;) { } }\n  int x = 1;\n}\n", [("A", "class", 3, 7, True), ("f", "method", 5, 5, True)]),
    ("cpp", "#define X {\nnamespace a { class B final : public C<D> { public: B() : x(1) {} ~B() {} int f() const override { return 1; } }; }\nint a::B::g() { if (x) {} }\nstruct S s = { 1 };\n", [("B", "class", 2, 2, True), ("B", "method", 2, 2, True), ("B", "method", 2, 2, True), ("f", "method", 2, 2, True), ("g", "method", 3, 3, True)]),
    ("go", "type A struct {\n x int }\nfunc (a *A) f() func() { return func() {} }\nvar g = func() {}\nfunc h[T any](x T) {}", [("A", "struct", 1, 2, True), ("f", "method", 3, 3, True), ("h", "function", 5, 5, True)]),
    ("go", "import \"x\"\nvar s = `{`\nfunc torn() {\n", [("torn", "function", 3, 3, False)]),
]


@pytest.mark.parametrize("language,text,wanted", CASES)
def test_declarations(language, text, wanted):
    assert found(text, language) == wanted


@pytest.mark.parametrize("language", LANGUAGES)
def test_time_grows_with_the_text(language):
    for text in ("a b c " * 100_000, "a<" * 100_000, '"' * 100_000, "{" * 50_000, "(" * 100_000, "/*" * 100_000, "int x = 1;\n" * 30_000, "def f(a):\n  x\n" * 15_000, "public static final A<B> " * 20_000):
        began = time.time()
        symbols_of(text, language)
        assert time.time() - began < 5, (language, text[:12])


def test_bytes_lines_and_odd_rows(spark):
    text = "# é\r\nclass Ä:\r\n    def b(self):\r\n        return 'ü'\r\n"
    f = spark.createDataFrame([(1, "r/a.py", text, "x"), (2, None, text, "x"), (3, "r/b.py", None, "x"), (None, "r/c.py", text, "x"), (4, "r/d.css", text, "x"), (5, "r/e.py", "", "x")], "id long, path string, content string, name string")
    rows = sorted(extract_symbols(f).collect(), key=lambda r: r["start_byte"])
    assert [(r["file_id"], r["name"], r["kind"], r["start_line"], r["end_line"]) for r in rows] == [(1, "Ä", "class", 2, 4), (1, "b", "method", 3, 4)]
    data = text.encode()
    assert data[rows[1]["start_byte"]: rows[1]["end_byte"]].decode() == "    def b(self):\r\n        return 'ü'" and rows[1]["signature"] == "def b(self)"
    assert extract_symbols(f.limit(0)).count() == 0
