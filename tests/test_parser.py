"""Definitions and calls by hand-made expectations, in well-formed and in broken files."""

import glob
import os
import random

import pytest

from sparkloom.sources import lexer, parser


def read(text, language):
    """([scope path, kind, first line, last line], [caller, callee, line]) as short strings."""
    symbols, calls = parser.parse_text(text, language)
    return [f"{s[1]} {s[2][0]} {s[3]}-{s[4]}" for s in symbols], [f"{symbols[c][0]}>{n}:{line}" for c, n, line in calls]


def check(text, language, symbols, calls):
    got = read(text, language)
    assert got[0] == symbols.split(", ")
    assert got[1] == calls.split()


def test_rust():
    check('''mod m {
  pub struct P(i32, String);
  #[derive(Debug)]
  pub enum E { A(i32), B }
  impl<T: Foo> Trait<T> for super::Bar<T> where T: Z<u8> {
    pub(crate) fn new(x: &'static str) -> Option<Self> {
      let Some(v) = get(x) else { return None };
      match v { Some(q) if cond(q) => go(q), Ok(z) | Err(z) => Self::new(z), _ => println!("{}", hidden(1)) }
    }
    fn sig(&self);
  }
  trait Tr { fn need(&self) -> u8; fn has(&self) -> u8 { self.need() } }
  fn f<'a>(g: impl Fn(u8) -> u8) -> impl Iterator<Item = u8> { let c = '{'; r#"{"#; /* { /* */ */ x.map(|a| g(a)) }
}
macro_rules! m { ($x:expr) => { fn no() { none($x) } }; }
fn r#type() { raw() }''', "rust",
        "m::P c 2-2, m::E c 4-4, m::Bar c 5-11, m::Bar::new f 6-9, m::Tr c 12-12, m::Tr::has f 12-12, m::f f 13-13, type f 16-16",
        "new>get:7 new>go:8 new>new:8 has>need:12 f>map:13 f>g:13 type>raw:16")


def test_go():
    check('''package main
type A struct { f func(x int) error }
type (
  B interface { Foo(x int) error }
  C int
  D = A
)
func (a *A) Run(x []int) (err error) {
  y := make([]byte, 3); go a.f(x); z := []byte(str(x)); `raw { "`; r := '"'
  return func() error { return deep(z) }()
}
func Map[T any](x T) T { switch v := x.(type) { case int: use(v) }; return x }
func asm(x int)
func last() { done(new(T)) }
''', "go", "A c 2-2, B c 4-4, C c 5-5, Run f 8-11, Map f 12-12, asm f 13-13, last f 14-14",
        "Run>make:9 Run>f:9 Run>str:9 Run>deep:10 Map>use:12 last>done:14 last>new:14")


def test_java():
    check('''package p;
@Anno(value = "x{", n = foo(1))
public class A<T> extends B implements C {
  private int f = start(1), g;
  public A(int x) { super(x); init(x); }
  @Override
  public <R> List<R> run(int x, Map<String, int[]> m) throws E, F {
    new Thread(new Runnable() { public void run() { inner(); } }).start();
    Foo<Bar> z = new Foo<>(calc(x)); char c = '"'; return this.<R>help(x);
  }
  abstract int need(int y);
  enum Color { RED(1) { int v() { return val(); } }, BLUE(2); Color(int i) { set(i); } }
  interface I { void a(); default int b() { return c(); } }
  record R(int x) { int twice() { return dbl(x); } }
  String s = """
    not() { "{
    """;
}''', "java",
        "A c 2-18, A::run f 6-10, A::run::run f 8-8, A::need f 11-11, A::Color c 12-12, A::Color::v f 12-12, A::I c 13-13, A::I::a f 13-13, A::I::b f 13-13, A::R c 14-14, A::R::twice f 14-14",
        "A>start:4 A>init:5 run>inner:8 run>start:8 run>calc:9 run>help:9 v>val:12 Color>set:12 b>c:13 twice>dbl:14")


def test_c():
    check('''#include <x.h>
#define BEGIN {
#define F(x) \\
   g(x) {
struct foo { int a; };
typedef struct bar { int (*cb)(int); } bar_t;
static struct foo *
make(int n)
{
#ifdef X
  if (n) { one(n);
#else
  if (!n) { two(n);
#endif
  }
  char c = '{'; return alloc("}", n);
}
int old(a, b) int a; char *b; { return a + call(b); }
struct foo g = { 1 };
int decl(int x);
MACRO(x);
int main(void) { struct foo x; int (*p)(int) = other; return sizeof(x) + (*p)(3) + run(x); }
''', "c", "foo c 5-5, bar c 6-6, make f 7-17, old f 18-18, main f 22-22", "make>one:11 make>two:13 make>alloc:16 old>call:18 main>run:22")  # fmt: skip


def test_cpp():
    check('''namespace n { namespace m {
template <class T, typename U>
class Box final : public Base<T>, private Other {
 public:
  explicit Box(int x) : a_(x), b_{make(x)} { init(); }
  ~Box() { drop(); }
  T get() const noexcept override { return this->val(); }
  virtual int pure(int) = 0;
  int inl(int a) { auto f = [&](int q) { return lam(q); }; return f(a); }
};
enum class K { A };
struct P { int x = 1'000; };
template <typename T> T Box<T>::out(int a) const { return help(a); }
Box::Box(char c) : Box(1) { boot(c); }
auto tail(int a) -> std::vector<int> { Foo x(1); return go(a); }
}}
extern "C" { int cfun(int a) { return R"x({ ")x"[0] + ext(a); } }
''', "cpp",
        "n::m::Box c 3-10, n::m::Box::Box f 5-5, n::m::Box::~Box f 6-6, n::m::Box::get f 7-7, n::m::Box::inl f 9-9, n::m::P c 12-12, n::m::Box::out f 13-13, n::m::Box::Box f 14-14, n::m::tail f 15-15, cfun f 17-17",
        "Box>make:5 Box>init:5 ~Box>drop:6 get>val:7 inl>lam:9 inl>f:9 out>help:13 Box>boot:14 tail>go:15 cfun>ext:17")


def test_typescript():
    check('''export class A<T extends {a: number}> extends mix(B, C) implements D {
  private x = init(1);
  constructor(private y: number) { super(y); this.go(); }
  public async load(x: string, cb = def()): Promise<{ a: number }> { return await fetch<T>(x).then(r => r.json()); }
  get v(): number { return calc(); }
  abs?(): void;
  #priv() { hid(); }
}
export function over(a: string): void;
export function over(a: any): { b: number } { return impl(a); }
const arrow = async (a: number): Promise<void> => { body(a); };
const one = x => { two(x) };
interface I { m(x: number): void; }
const o = { meth(a) { inside(a); }, other: function named() { deep(); } };
function last() { opt?.(1); a?.b(2); new Foo(arg()); }
''', "typescript",
        "A c 1-8, A::constructor f 3-3, A::load f 4-4, A::v f 5-5, over f 10-10, arrow f 11-11, one f 12-12, I c 13-13, meth f 14-14, last f 15-15",
        "A>mix:1 A>init:2 constructor>go:3 load>def:4 load>fetch:4 load>then:4 load>json:4 v>calc:5 A>hid:7 over>impl:10 arrow>body:11 one>two:12 meth>inside:14 last>opt:15 last>b:15 last>arg:15")


def test_javascript():
    check('''function a(){ return /"{/.test(x) && b(); }
function c(){ d(); }
class K { m(x) { return x / 2 / z(x) } static s = 1 }
function tpl() { return `a ${b(`${c()}`)} {`; }
async function re(x) { if (/[/]"/.test(x)) /'/.exec(y()); }
var q = function hidden() { no(); }
''', "javascript", "a f 1-1, c f 2-2, K c 3-3, tpl f 4-4, re f 5-5", "a>test:1 a>b:1 c>d:2 K>z:3 tpl>b:4 tpl>c:4 re>test:5 re>exec:5 re>y:5")  # fmt: skip


def test_python():
    check('''@deco(1)
class C(base()):
    @prop(2)
    async def m(self, x=default()):
        def inner(): return f"{call(x)} {{no()}}"
        return (inner()
                .chain())
''', "python", "C c 2-7, C::m f 4-7, C::m::inner f 5-5", "C>base:2 C>prop:3 m>default:4 inner>call:5 m>chain:7 m>inner:6")  # fmt: skip


@pytest.mark.parametrize("bad", ["    print 'x'", "    x = foo(1, 2", "    y = = 3", "    s = 'open", "  ) ] }", "    if x"])
def test_broken_python_line(bad):
    text = f"class A:\n    def m(self):\n        return n(1)\n\ndef a():\n{bad}\n    b()\n\ndef c(x: int) -> int:\n    return d(x)\n"
    symbols, calls = read(text, "python")
    assert symbols[:2] == ["A c 1-3", "A::m f 2-3"] and symbols[-1] == "c f 9-10" and symbols[2].startswith("a f 5-") and len(symbols) == 4
    assert calls[0] == "m>n:3" and calls[-1] == "c>d:10" and "a>b:7" in calls


@pytest.mark.parametrize(
    "text, language",
    [
        ("function a() { if (x) { foo();\n}\nfunction b() {\n  bar();\n}\n", "javascript"),
        ("fn a() {\n    foo(;\n    if x {\n}\n\nfn b() {\n    bar();\n}\n", "rust"),
        ("func a() {\n\tfoo()\n\tfor {\n}\n\nfunc b() {\n\tbar()\n}\n", "go"),
        ("int a(void)\n{\n  foo();\n  while (1) {\n}\n\nint b(void)\n{\n  bar();\n}\n", "c"),
        ("class X {\n  void a() {\n    foo();\n    if (x) {\n  }\n\n  void b() {\n    bar();\n  }\n}\n", "java"),
        ("int a() {\n  foo('x);\n}\n}\nint b() {\n  bar();\n}\n", "cpp"),
        ("class X {\n  a(): void {\n    foo(\n  }\n  b(): void {\n    bar();\n  }\n}\n", "typescript"),
    ],
)
def test_errors_stay_local(text, language):
    """A missing or superfluous bracket in one definition leaves the next one beside it, with its own calls."""
    symbols, calls = parser.parse_text(text, language)
    names = {s[0]: s for s in symbols}
    assert "::a" not in names["b"][1].removeprefix("X")
    assert {(symbols[c][0], n) for c, n, _ in calls} >= {("a", "foo"), ("b", "bar")} and ("a", "bar") not in {(symbols[c][0], n) for c, n, _ in calls}


def test_indentation_reads_as_the_grammar_does():
    """The reader for broken files, on well-formed ones: all definitions alike, all but a few calls."""
    files = sorted(glob.glob(os.path.join(os.path.dirname(os.__file__), "*.py")))[:90]
    assert len(files) > 40
    n = off = 0
    for path in files:
        with open(path, encoding="utf-8", errors="replace") as f:
            text = f.read()
        a, b = parser._python(text), parser._indented(text)
        assert a[0] == b[0], path
        left, right = ({(x[0][c][1], n, line) for c, n, line in x[1]} for x in (a, b))
        n, off = n + len(left), off + len(left ^ right)
    assert off <= n / 500


@pytest.mark.parametrize("language", sorted(parser.NOT_CALLED))
def test_any_text_ends(language):
    rng = random.Random(7)
    parts = ["{", "}", "(", ")", "[", "]", "<", ">", "'", '"', "`", "${", "/*", "*/", "//", "\\", "\n", " ", "#if x\n", "#else\n", "fn f", "func f", "class C", "def f", "impl", "type", "new", ";", ":", "=", "=>", "a", "R\"(", "r#\"", "let", "é"]
    for _ in range(300):
        text = "".join(rng.choices(parts, k=rng.randrange(60)))
        symbols, calls = parser.parse_text(text, language)
        lines = text.count("\n") + 1
        assert all(1 <= s[3] <= s[4] <= lines for s in symbols) and all(0 <= c < len(symbols) and 1 <= x <= lines for c, _, x in calls)
    assert parser.parse_text("", language) == ([], [])


def test_tokens_cover_the_text():
    text = 'f(`a${g({x: `${h}`})}b`, /[/"]/g, "q\\"r") // end'
    found = lexer.tokens(text, "javascript")
    assert [t.text for t in found if t.kind == "w"] == ["f", "g", "x", "h"] and len(lexer.pairs(found)) == 6
