"""Definitions of languages without a parser: line spans by hand, nested ones, braces and keywords in strings and comments."""

import time

import pytest
from tessera.operators import chunks, languages
from tessera.operators.definitions import RULES, definitions

CASES = [
    ("java", 'package a;\n// class No { }\npublic class A<T> extends B {\n  private int x = f(1);\n  public A(int x) {\n    if (x > 0) { g("}{"); }\n  }\n  @Override\n  public List<String> run(Map<String, Integer> m) throws E\n  {\n    return new ArrayList<>();\n  }\n  abstract void f(int y);\n}\n', [(3, 14), (5, 7), (8, 12), (13, 13)]),
    ("java", "interface I { void g(); }\n/* enum No { } */ enum E { X, Y }\nrecord R(int x) { }\n", [(1, 1), (2, 2), (3, 3)]),
    ("csharp", "using X;\nnamespace N {\npublic class A : B\n{\n  public int P { get; set; }\n  public A(int x) : base(x) { }\n  public async Task<int> Run(string s) {\n    foreach (var x in y) { Do(\"{\"); }\n    return 1;\n  }\n}\nstruct S { }\n}\n", [(3, 11), (5, 5), (6, 6), (7, 10), (12, 12)]),
    ("csharp", 'interface I { void F(); }\nrecord R { string S = @"a""}"; }\n', [(1, 1), (2, 2)]),
    ("kotlin", "package a\nclass A(val x: Int) {\n  fun f(a: Int): Int = a + 1\n  fun g() {\n    if (x) { }\n  }\n  companion object { val z = 1 }\n}\nobject O\n", [(2, 8), (3, 3), (4, 6), (7, 7), (9, 9)]),
    ("kotlin", 'val s = """fun no() {"""\nprivate fun g(\n  a: Int,\n) {\n}\n', [(2, 5)]),
    ("scala", "object O {\n  def f(x: Int): Int = {\n    x\n  }\n  def g = 1\n}\ntrait T { }\n", [(1, 6), (2, 4), (5, 5), (7, 7)]),
    ("scala", "// def no\nfinal case class P(x: Int)\nclass Q { }\n", [(2, 2), (3, 3)]),
    ("rust", "impl<'a> A<'a> {\n  pub fn f(&self) -> u8 { b'}' ; '{'; 1 }\n}\nfn main() {\n  let x = |a| { a };\n}\nfn decl();\n", [(1, 3), (2, 2), (4, 6)]),
    ("rust", "/* fn no() { */\npub(crate) async fn g<T>(x: T) where T: A\n{\n}\n", [(2, 4)]),
    ("php", "<?php\n# class No {}\nfinal class A {\n  public function f($a = array(1)) { return '}'; }\n  abstract function g();\n}\nfunction h() {\n}\n", [(3, 6), (4, 4), (5, 5), (7, 8)]),
    ("php", "<?php\n#[Attr]\nclass B extends A { }\n$f = 1;\n", [(3, 3)]),
    ("c", "#include <a.h>\nint g(int);\nstatic int\nf(int a, char *b)\n{\n  if (a) { return '}'; }\n  return g(a);\n}\nstruct s { int x; };\nvoid h(void) { }\n", [(3, 8), (10, 10)]),
    ("c", "/* int no(void) { */\nchar *k(int (*f)(int)) {\n  while (1) { }\n}\n", [(2, 4)]),
    ("cpp", "template <class T>\nclass A {\n public:\n  A() : x(1) { }\n  int f() const { return x; }\n};\nint A::g(int a) {\n  while (a) { a--; }\n}\n", [(1, 6), (4, 4), (5, 5), (7, 9)]),
    ("cpp", 'class F;\nstd::string s(const std::string& x) { return "}"; }\n', [(2, 2)]),
    ("shell", '#!/bin/sh\nf() {\n  echo "}" # }\n  if [ $# -gt 0 ]; then echo ${x}; fi\n}\nfunction g {\n  :\n}\n', [(2, 5), (6, 8)]),
    ("shell", "# f() {\nf-g ()\n{\n}\n", [(2, 4)]),
    ("lua", "local function f(a)\n  if a then return 1 end\n  for i = 1, 2 do print('end') end\n  repeat x() until y\nend\nfunction M.g() end\n", [(1, 5), (6, 6)]),
    ("lua", "--[[ function no()\n]]\nfunction M:h()\n  local function i() end\n  while x do end\nend\n", [(3, 6), (4, 4)]),
    ("ruby", "module M\n  class A < B\n    def f(x)\n      return 1 if x\n      y = if x then 1 else 2 end\n      while x do\n        z.each do |w| puts 'end' end\n      end\n      self.class\n    end\n  end\nend\n", [(1, 12), (2, 11), (3, 10)]),
    ("ruby", "=begin\ndef no\n=end\ndef self.g\n  x.end\n  begin\n  end\nend\n", [(4, 8)]),
    ("elixir", 'defmodule A do\n  @doc "do end"\n  def f(x) do\n    case x do\n      1 -> fn -> 2 end\n    end\n  end\n  defp g(x), do: x\nend\n', [(1, 9), (3, 7), (8, 8)]),
    ("elixir", "# def no do\ndefmacro m(x) do\n  x\nend\n", [(2, 4)]),
    ("haskell", "module A where\nimport B\n\nf :: Int -> Int\nf 0 = 1\nf n\n  | n > 1 = 2\n\n  | otherwise = g\n  where\n    g = 3\ndata X = Y\nh = 1 -- x\n", [(4, 4), (5, 5), (6, 11), (13, 13)]),
    ("haskell", "{- f = 1\n-}\ng x =\n  x\n\ninstance A B where\n  h = 1\n", [(3, 4)]),
]


@pytest.mark.parametrize("case", CASES, ids=lambda c: c[0])
def test_spans(case):
    language, source, spans = case
    found = definitions(language, source)
    assert [(a, b) for a, b, _ in found] == spans
    lines = source.split("\n")
    for a, b, text in found:
        assert text and text in "\n".join(lines[a - 1 : b]) and text == text.strip()


@pytest.mark.parametrize("language", sorted(RULES))
def test_odd_sources(language):
    assert definitions(language, "") == [(1, 1, "")] and definitions(language, "12 +\n\n") == [(1, 3, "12 +\n\n")]
    began = time.time()
    for source in ("word (x) " * 10_000, "a b c(\n" * 10_000, "{" * 50_000, '"' * 49_999, "do " * 20_000, "x = 1\n" * 10_000, " " * 50_000, "\n" * 50_000, "class " * 5_000, "}\nend\n" * 10_000, "/*" * 20_000):
        for a, b, text in definitions(language, source):
            assert 1 <= a <= b <= source.count("\n") + 1
    assert time.time() - began < 20


def test_files_get_their_language(spark):
    files = spark.createDataFrame([("A.java", "class A { }\nclass B { }"), ("x.rb", "def f\nend"), ("y.md", "# class A"), ("z.lua", "x = 1"), ("bad.c", None)], "rel_path string, text string")
    found = chunks.chunks(languages.supported(files)).orderBy("rel_path", "chunk_no").collect()
    assert [(r.rel_path, r.chunk_no, r.start_line, r.end_line, r.text) for r in found] == [("A.java", 0, 1, 1, "class A { }"), ("A.java", 1, 2, 2, "class B { }"), ("x.rb", 0, 1, 2, "def f\nend"), ("y.md", 0, 1, 1, "# class A"), ("z.lua", 0, 1, 1, "x = 1")]
