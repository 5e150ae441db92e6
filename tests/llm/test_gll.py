import ast
import random
import warnings

import pytest

from leanspan.llm.gll import Grammar
from leanspan.llm.languages import LANGUAGES, language
from leanspan.llm.parsecheck import judge, parses, rates, unparsed


def accepts(g, rule, tokens):
    return g.derives(rule, "".join(g.literals[t] for t in tokens))


def brute(rules, rule, tokens):
    """Whether a grammar of plain alternatives derives the tokens, by trying everything."""
    memo = {}

    def spans(name, i):
        key = (name, i)
        if key not in memo:
            memo[key] = set()
            while True:
                new = set()
                for alt in rules[name]:
                    ends = {i}
                    for sym in alt:
                        ends = {e2 for e in ends for e2 in (spans(sym, e) if sym in rules else ({e + 1} if e < len(tokens) and tokens[e] == sym else set()))}
                    new |= ends
                if new <= memo[key]:
                    break
                memo[key] |= new
        return memo[key]

    return len(tokens) in spans(rule, 0)


@pytest.mark.parametrize("text, rules", [
    ("s = 'a' s 'b' | 'a' 'b' | s2 ; s2 = 'a' s2 | 'a' ;", {"s": [["a", "s", "b"], ["a", "b"], ["s2"]], "s2": [["a", "s2"], ["a"]]}),
    ("s = e ; e = t ('b' t)* ; t = 'a' | 'a' 'b' 'a' ;", {"s": [["e"]], "e": [["t"], ["t", "b", "e"]], "t": [["a"], ["a", "b", "a"]]}),
    ("s = 'a'? s 'b' | 'a' ;", {"s": [["a", "s", "b"], ["s", "b"], ["a"]]}),
])
def test_equals_brute_force_on_ambiguous_and_left_recursive_grammars(text, rules):
    g = Grammar(text)
    rng = random.Random(1)
    for _ in range(200):
        tokens = [rng.choice("ab") for _ in range(rng.randrange(0, 7))]
        assert accepts(g, "s", tokens) == brute(rules, "s", tokens), tokens


def test_memoised_rules_give_the_same():
    plain, memo = Grammar("s = x* ; x = 'a' 'b'* | 'a' 'a' ;"), Grammar("s = x* ; !x = 'a' 'b'* | 'a' 'a' ;")
    rng = random.Random(2)
    for _ in range(200):
        tokens = [rng.choice("ab") for _ in range(rng.randrange(0, 9))]
        assert accepts(plain, "s", tokens) == accepts(memo, "s", tokens)


GOOD = {
    "python": ["", "\n", "x = 1", "def f(a, *, b=1, **k) -> int:\n    '''d'''\n    return a if b else (yield)\n", "match x:\n    case {'a': [1, *r]} if r:\n        pass\n    case _: pass\n", "@d(1)\nasync def f():\n  async with a as b, c:\n    await x\n", "if a:\n\tpass\nelif (b := 2): x[1:2, ...] = [i for i in y if i]\n", "f\"{x!r}\" 'y'\nlambda *a, k=1: a\nprint(*a, **b)\n", "type X[T] = list[T]\nclass A[T](B, m=C): x: int = 3; y = 4\n", "try:\n  pass\nexcept* (A, B) as e:\n  raise X from e\n", "x = {**a, 'b': 1}\ny = {1, *z}\nfor i, *j in k: del i\nelse:\n  pass\n"],
    "rust": ["", "#![allow(x)]\npub(crate) fn f<'a, T: Into<String> + 'a>(x: &'a mut T, (a, _): (u8, u8)) -> Result<Vec<Vec<T>>, ()> where T: Clone { let S { a, .. } = s else { return Err(()) }; Ok(vec![]) }", "impl<T> X for Y<T> { const A: u8 = 1 << 2; type B = dyn Fn(u8) -> u8 + Send; fn c(self: &Self) -> impl Iterator<Item = u8> + '_ { if let Some(x) = y && z { } else if a < b { match x { 1..=2 | 3 => {} Some(n @ 4..) if n > 1 => n?.await, _ => (), } } 'l: loop { break 'l; } |a: u8, b| -> u8 { a >> b } } }", "macro_rules! m { ($x:expr) => { $x } }\nstatic S: &str = r#\"a\"b\"#; enum E { A(u8), B { x: u8 } = 3, C }", "use a::{self, b::*, c as d};\nfn main() { let x = a as u8 < b; for i in 0..10 { x.0.1[i] += 1; } unsafe { *p = !q } S::<u8>::f::<T>(x, ..y); }"],
    "go": ["package a\n", "package a\nimport (\n\t\"x\"\n\t. \"y\"\n)\nfunc (s *S[T]) F(a, b int, c ...string) (x int, err error) {\n\tif v, ok := m[k]; !ok {\n\t\treturn\n\t} else if x > 1 {\n\t}\n\tfor i := range 10 {\n\t}\n\tfor ; ; {\n\t}\n\tswitch v := x.(type) {\n\tcase int, *T:\n\tdefault:\n\t}\n\tselect {\n\tcase c <- 1:\n\tcase v := <-d:\n\t}\n\tgo func() {}()\n\tx := []T{{1, 2}, {a: 3}}\n\treturn\n}\n", "package a\ntype (\n\tA struct {\n\t\tX, Y int `json:\"x\"`\n\t\t*B\n\t}\n\tI interface {\n\t\tM(int) error\n\t\t~int | ~string\n\t}\n)\nconst (\n\tc = iota\n\td\n)\nvar f func(a int) chan<- map[string][]int\n"],
    "javascript": ["", "#!/usr/bin/env node\nimport a, { b as c } from 'x'\nexport default class A extends B { #p = 1; static { } get x() { return this.#p } async *[y](z = 1, ...r) {} }\n", "const f = async ({ a, ...b }, [c, , d] = []) => { for await (const x of y) { if (a) b\n else c } }\nlabel: for (;;) { continue label }\n", "let x = a ? b : c ?? /re[/]/g.test(`t ${a + `${b}`}`), y = { a, b: 1, [c]: 2, get d() { return 1 }, ...e, async f() {} }\nx++\ny\n(z)\n", "if (a) return_\nelse do x(); while (y)\nswitch (a) { case 1: default: break }\nnew a.b(...c)?.d?.[e]\n`x`\n", "export * as n from 'm'; export { a as b, c }; export const [q] = r\n"],
    "typescript": ["interface A<T extends B = C> extends D<T>, E { readonly x?: string; [k: string]: unknown; (a: number): void; new (x: T): A<T>; m?<U>(this: A, u: U): u is string }\n", "export abstract class X<T> implements Y { constructor(private readonly a: string, public b?: number) { super() } declare z: string; abstract f(): void; static readonly g = <T,>(x: T) => x; get h(): string { return this.a! } }\n", "type M<T> = { readonly [K in keyof T as `x${string & K}`]?: T[K] extends infer U ? U[] : never } | [a: string, b?: number, ...c: T[]] | typeof import('x') | (new () => void)\n", "enum E { A = 1, 'B', C = A << 2 }\ndeclare module 'x' { export const y: number }\nnamespace N.M { const z = 1 as const satisfies number }\nfunction f(a: string): void;\nfunction f(a: any): asserts a is string { const m = new Map<string, number[]>(); return m.get(a)!.x as unknown as Array<Array<number>> }\n@dec() class K { @p() x = 1 }\n"],
    "java": ["", "package a.b;\nimport static a.B.*;\n@A(x = 1, y = {2, 3}) public final class C<T extends D & E> extends F<T[]> implements G, H { int[] a = {1, 2}, b[]; static { } C(int... x) throws E { super(); } <U> List<? super U> m(final Map<String, List<Integer>> k) { for (var x : k) if (x instanceof Foo f && f.y) continue; else return (T) x; return switch (a) { case 1, 2 -> { yield 3; } case Foo(int q) when q > 1 -> 4; default -> throw new X(); }; } }\n", "enum E { A(1) { void f() {} }, B; int x; }\ninterface I { default void f() { Runnable r = () -> {}; g(C::new, int[]::clone, (a, b) -> a >>> b); } @interface J { int v() default 1; } }\nrecord R<T>(int a, @N T b) { R { } }\nsealed interface S permits R {}\n", "class T { void f() { try (var a = b(); c) { } catch (A | B e) { } finally { } int x = a ? b : c; synchronized (this) { do { x >>= 2; } while (x > 1); } String s = \"\"\"\n a \"q\" b\n\"\"\"; new int[3][]; l: for (int i = 0, j = 1; i < j; i++, j--) break l; } }\n"],
    "cpp": ["", "#include <a>\n#define X(a) \\\n  a\ntemplate <typename T, int N = 3, class... Ts> requires C<T> class A : public B<T>, private virtual D { public: explicit A(int x = 1) noexcept : B{x}, y(x) {} ~A() override = default; A& operator=(const A&) = delete; bool operator()(int) const; friend std::ostream& operator<<(std::ostream& o, const A& a); private: int x : 3; static constexpr auto k = N; };\n", "namespace a::b { inline auto f(auto&& x, const std::map<std::string, std::vector<int>>& m) -> decltype(x.y()) { for (const auto& [k, v] : m) { if (auto it = m.find(k); it != m.end()) continue; else switch (v) { case 1: break; default: return {}; } } auto g = [=, &x, this]<typename T>(T t) mutable -> int { return t ? *p++ : (int)q << 2; }; return static_cast<T*>(x)->z[1](2), new T[3]{1, 2}; } }\n", "enum class E : std::uint8_t { A = 1, B, };\nusing F = void (*)(int, char*);\ntypedef struct { int a[3]; } S;\nstatic const unsigned char d[] = { 0x1, 'a', 1'000u, 2.5e-3f };\nextern \"C\" { int g(void); }\nint main(int argc, char* argv[]) { std::cout << R\"x(a \" )b)x\" \"c\" << std::endl; do { } while (a < b && c > d); try { throw 1; } catch (...) { } goto e; e: return sizeof(int) + sizeof x; }\n"],
}
BAD = {
    "python": ["def f(:\n  pass\n", "x = (1\n", "if a\n  b\n", "print 'x'\n", "<<<<<<< HEAD\n", "  x = 1\ny = 2\n", "def f():\nreturn 1\n", "x = “a”\n", "a = = 1\n", "'abc\n", "class A:\n", "6fd4b = 1\n", "for in x: pass\n"],
    "rust": ["fn f( {}", "fn f() { let x = ; }", "struct S { a: u8 b: u8 }", "fn f() { x y }", "fn f() { \"abc }", "use a::;", "=======\n", "fn f() }", "match x {}"],
    "go": ["func f() {}\n", "package a\nfunc f() {\n", "package a\nvar x = = 1\n", "package a\nfunc f() { if { x() } }\n", "package a\nfunc f()\n{\n}\n", "package a\nx := 1\n", "package a\nfunc f() { for _, := range x { } }\n"],
    "javascript": ["function f( {", "let x = = 1", "for (;;;) {}", "if (a) else b", "a b", "x = “a”", "}", "class { x() { }", "const", "import from", "`abc", "diff --git a/x b/y\n"],
    "typescript": ["interface { }", "let x: = 1", "type A = ;", "function f(a: string b: string) {}", "enum E { A B }", "class A { x: string y: number }", "const x: Map<string = 1"],
    "java": ["class A {", "class A { int x }", "class A { void f() { x y z; } }", "public class { }", "class A { void f() { if (a) else b(); } }", "class A { String s = \"a; }"],
    "cpp": ["int f( { }", "int main() { return 1 }", "class A { int x; }", "int a = 5 int b = 3;", "else { }", "template <typename T>", "int x = ‘a’;", "Sure, the worker goes here: it walks.", "void f() { /* open"],
}


@pytest.mark.parametrize("name", LANGUAGES)
def test_grammars(name):
    lang = language(name)
    for text in GOOD[name]:
        assert parses(text, name), (name, text)
        assert parses("﻿" + text.replace("\n", "\r\n"), name), (name, "CRLF", text)
    for text in BAD[name]:
        assert not parses(text, name), (name, text)
    for other, texts in GOOD.items():
        # foreign text that is long enough to be told apart
        if name != other and {name, other} != {"javascript", "typescript"}:
            assert not any(parses(t, name) for t in texts if len(t) > 120), (name, other)
    assert lang is language(name)


def test_python_grammar_equals_the_compiler_on_damaged_files(data):
    import pandas as pd

    files = pd.read_parquet(f"{data}/files.parquet")
    texts = [t.lstrip("﻿") for t in files[files["language"] == "python"]["content"]]
    rng = random.Random(4)
    warnings.simplefilter("ignore")

    def ok(t):
        try:
            ast.parse(t)
            return True
        except (SyntaxError, ValueError) as e:
            # scopes and names are not the grammar's
            return any(x in str(e) for x in ("outside", "duplicate argument"))

    for text in texts:
        assert parses(text, "python") == ok(text)
        for _ in range(3):
            k = rng.randrange(len(text) + 1)
            cut = rng.choice([text[:k], text[:k] + rng.choice("()[]{}:=,") + text[k:], text[:k] + text[k + 1:]])
            if parses(cut, "python") != ok(cut):
                # the compiler knows more rules than the grammar, never fewer
                assert parses(cut, "python"), cut[-80:]


# Targets, the order of parameters and arguments, and expression statements.
PYTHON_BAD = ["1 = x","f() = 1","x + 1 += 2","def f(a=1, b): pass","def f(**k, a): pass","f(a=1, 2)","f(**k, *a)","del f()","(a, b) += 1","for f() in x: pass","lambda a=1, b: 0","[a, b]: int = 1", "def f(*, **k): pass","with a as f(): pass","def f(/, a): pass"]
PYTHON_GOOD = ["a, *b = c","a = b = c, d","(a) = 1","(a.b): int = 1","x[1] += 2","a.b, c[0] = f(x)","def f(a, /, b, *, c=1, **k): pass","def f(a=1, /, b=2, *c, d, **k,): pass","f(*a, b, c=1, *d, **e, g=2)","del a, b[0], (c.d)","for a, (b, *c) in d: pass","f(x for x in y)","lambda *a, b=1, **k: 0","with a as (b, c), d as e.f: pass","a = yield b","x: int","print(*a, sep='')","f(a)(b).c = 1","[a, b] = c","() = a", "f(a := 1, b=2)","class A(B, metaclass=C): pass","lambda: (yield)","a = b if c else d","def f(a, b: int = 1, *args: *T, c): pass"]
OTHERS = (("javascript",["a = b = c;","a.b = c;","a[0] += f(x);","[a, b] = [b, a];","({a, b} = c);","(a) = 1;","a ? b : c = d;","x = async () => { await y; };","a => b => c = 1;","a >>= 1;","a >>>= 2; b = a >>> 1;","x = a >= b;","a ??= b || c;","this.x = y => z;","for (const a of b) {}","for (a.b in c) {}","f(a = 1, ...b);","new A().b = 1;","import.meta.x = 1;","super.x = 1;","x = y, z = w;","let a = 1, b = a = 2;","export default a = b;","a?.b(c) ?? d;","var f = function () {}, g = class {};","x = function* () { const a = yield b; yield* c; };","a.b.c++;"],["1 = 2;","a + b = c;","f() = 1;","!a = 1;","a || () => 1;","a ? b : c ? d : 1 = 2;","++a = 1;"]),
  ("typescript",["a! = 1;","(a as any) = 1;","(a as any).b = 1;","<any>a = 1;","let x: A<B>= c;","x = <T>(a: T) => a;","const f = async <T,>(x: T): Promise<T> => x;","a.b! += 1;","let y = a as B as C;","enum E { A = 1 << 2, B = A | 1 }"],["1 = 2;","a + b = c;"]),
  ("java",["class A { void f() { a = b = c; a.b[0] += 1; x++; --y; new A(); new A().b(); this.f(); super.f(); a.new B(); (a).b(); int[] x = {1}; for (int i = 0; i < n; i++) f(i); y = z -> z = 1; a >>>= 2; x = a >= b ? c : d; Foo.<T>bar(); ((A) b).c(); A.super.f(); boolean q = x = y; switch (a) { case 1 -> f(); default -> x = 2; } f().g().h = 3; i--; assert a : b; } }","class A { A() { this(1); } B() { super(); } }"],["class A { void f() { 1 + 2; } }","class A { void f() { a; } }","class A { void f() { a + b = c; } }","class A { void f() { f() = 1; } }","class A { void f() { -x.f(); } }"]),
  ("go",["package a\nfunc f() { a, b := 1, 2; a.b = c; for i, x := range y {}; for a.b = range c {}; switch x := y.(type) { case int: }; if v, ok := m[k]; ok {}; x++ ; <-c; c <- 1; select { case v := <-c: case c <- 2: } }\n"],["package a\nfunc f() { a.b := 1 }\n","package a\nfunc f() { for a[0] := range b {} }\n"]))


def test_targets_and_orders():
    for x in PYTHON_GOOD:
        ast.parse(x)
        assert parses(x + "\n", "python"), x
    for x in PYTHON_BAD:
        assert not parses(x + "\n", "python"), x
    for name, good, bad in OTHERS:
        for x in good:
            assert parses(x + "\n", name), (name, x)
        for x in bad:
            assert not parses(x + "\n", name), (name, x)


def test_python_of_others_is_accepted():
    """Files that nobody wrote for these tests: a part of the standard library."""
    import glob
    import os

    for f in sorted(glob.glob(os.path.dirname(os.__file__) + "/*.py"))[::6]:
        with open(f, encoding="utf-8") as h:
            assert parses(h.read(), "python"), f


def test_c_preprocessor_branches():
    text = "#ifdef A\nint f(int a) {\n#else\nint f() {\n#endif\n  return 1;\n}\n"
    assert parses(text, "cpp") and not parses(text.replace("return 1;", "return (1;"), "cpp")


def test_judge_nulls_duplicates_and_empty(spark):
    f = spark.createDataFrame(
        [(1, "python", "x = (", "r", True, "c"), (1, "python", "x = (", "r", True, "c"), (2, "python", "", "r", False, "c"), (3, None, "x = (", "r", True, "c"), (4, "python", None, "r", None, "c"), (None, "python", "(", None, None, None), (5, "css", "{", "r", True, "c"), (6, "go", "", "r", False, "c"), (7, "python", "x = 1\n" * 50_000, "r", True, "c")],
        "id long, language string, content string, repository string, structurally_complete boolean, parses string",
    )
    assert sorted(r["file_id"] for r in unparsed(f).collect()) == [1, 6]
    assert unparsed(f.limit(0)).count() == 0
    d = spark.createDataFrame([("v", "r", "python", "s", (3, 1, 10, 2, None))] * 2, "revision string, repository string, language string, source_shape string, counts struct<files:long,incomplete_files:long,source_bytes:long,error_nodes:long,missing_nodes:long>")
    got = {r["language"]: r for r in rates(f, d).collect()}
    assert got["python"]["files"] == 3 and got["python"]["unparsed"] == 1 and got["python"]["diagnosed_files"] == 3 and got["go"]["unparsed"] == 1
    assert judge(f).count() == 5
