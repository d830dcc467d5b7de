"""Outlines of files in languages of braces, and checks on them."""

import pytest

from quern.functions.braces import outline
from quern.operators import findings as A
from quern.operators import rules as R
from quern.operators import syntax as S
from quern.sources.loaders import parse_rules


def functions(source, lang):
    return [tuple(f) for f in outline(source, lang).functions]


GO = """package main

func topLevel() {
	x := 1
}

type Server struct{}

func (s *Server) Handle(w http.ResponseWriter, m map[string]interface{}) (a int, err error) {
	y := func(q int) bool { return q > 0 }
	for _, v := range []int{1, 2} {
		if v > '}' {
		}
	}
}

func (s Server) Other[T any](a, b, c int, d ...string) struct{} {
	s.x = `} " {` // }
}
"""


def test_go():
    assert functions(GO, "go") == [("topLevel", "", 3, 5, 0), ("Handle", "Server", 9, 15, 2), ("Other", "Server", 17, 19, 3)]
    assert [tuple(c) for c in outline(GO, "go").control] == [(11, 14, 1), (12, 13, 2)]


def test_java():
    source = """
@Service
public class Auth<T> extends Base {
  private int[] xs = {1, 2};
  public Auth(int a) { this.a = a; }
  @Override
  public <K extends Foo> List<K> find(Map<String, Integer> m, final int... rest) throws E {
    Runnable r = new Runnable() {
      public void run() { if (x) { y("}"); } }
    };
    for (int i = 0; i < 3; i++) if (i > 1) { z(); } else { w(); }
    try { a(); } catch (E e) {
    }
    try { a(); } catch (E e) {
      // said why
    }
    return null;
  }
  abstract void six(int a, int b, int c, int d, int e, int f);
}
"""
    assert functions(source, "java") == [("Auth", "Auth", 5, 5, 1), ("find", "Auth", 6, 18, 2), ("run", "Auth", 9, 9, 0), ("six", "Auth", 19, 19, 6)]
    assert outline(source, "java").empty_handlers == [(12, 13)]
    assert [tuple(c) for c in outline(source, "java").control] == [(9, 9, 1), (11, 11, 1), (11, 11, 2)]


def test_javascript_and_typescript():
    source = """class UserController {
  handle(req, {a, b}, ...rest) {
    return req.body.replace(/[}"]/g, '');
  }
  static async get(a = {}) { }
}
async function free(x) {
  const f = (a, b) => {
    return `${a}}`;
  };
  go(y => y + 1, function (z) { return z; });
}
const o = { run(a) { return 1; }, k: 2 };
try { free(); } catch {
}
"""
    assert functions(source, "javascript") == [("handle", "UserController", 2, 4, 2), ("get", "UserController", 5, 5, 1), ("free", "", 7, 12, 1), ("<anonymous>", "", 8, 10, 2), ("<anonymous>", "", 11, 11, 1), ("run", "", 13, 13, 1)]
    assert outline(source, "javascript").empty_handlers == [(14, 15)]
    typed = "export class A {\n  m(a: string, b?: {x: number}): Promise<void> {\n    const g = (q: number): string => {\n      return '' };\n  }\n}\n"
    assert functions(typed, "typescript") == [("m", "A", 2, 5, 2), ("<anonymous>", "A", 3, 4, 1)]


def test_c_and_rust():
    c = "#define X {\nstruct S { int a; };\nstatic int *f(int a, char b)\n{\n  while (a) { switch (b) { case 1: if (a) return 0; } }\n  int xs[] = {1, 2};\n}\n"
    assert functions(c, "c") == [("<anonymous>", "", 3, 7, None)]
    assert [tuple(x) for x in outline(c, "c").control] == [(5, 5, 1), (5, 5, 2), (5, 5, 3)]
    rust = """
impl<T: Foo<U>> Handler for Server<T> where T: X {
    #[inline]
    pub async fn serve<'a>(&'a mut self, c: char, d: Vec<(i32, i32)>) -> Result<(), E> {
        let s = r#"} " {"#;
        let p = Point { x: 1 };
        match c { '}' => { if let Some(q) = d.first() { go(q) } else if c == 'x' { no() } } _ => {} }
        loop { break; }
    }
}
fn free() {}
"""
    assert functions(rust, "rust") == [("serve", "Server<T>", 4, 9, 2), ("free", "", 11, 11, 0)]
    assert [tuple(x) for x in outline(rust, "rust").control] == [(7, 7, 1), (7, 7, 2), (7, 7, 3), (8, 8, 1)]


def test_else_if_is_nested_and_spans_its_chain():
    source = "package p\nfunc f() {\n\tif a {\n\t} else if b {\n\t} else {\n\t\tfor {\n\t\t}\n\t}\n}\n"
    assert [tuple(c) for c in outline(source, "go").control] == [(3, 8, 1), (4, 8, 2), (6, 7, 3)]


@pytest.mark.parametrize(("body", "found"), [("\tif err != nil {\n\t}\n", [(3, 4)]), ("\tif err := f(); err != nil {\n\n\t} else {\n\t\tg()\n\t}\n", [(3, 7)]), ("\tif err != nil {\n\t\tfmt.Println(err)\n\t}\n", []), ("\tif x > 0 {\n\t}\n", []), ("\tif err != nil {\n\t\t// why\n\t}\n", [])])
def test_empty_go_handlers(body, found):
    assert outline(f"package p\nfunc f() {{\n{body}}}\n", "go").empty_handlers == found


def test_broken_and_unknown_files():
    assert outline("func f( {{{ ) }", "cobol").functions == []
    for lang in ("go", "java", "javascript", "typescript", "c", "rust"):
        for text in ("", "}}}", "((((", "func f(", '"', "`", "/*", "if {", "else {", "x) => {"):
            outline(text, lang)


def deep(n):
    return "package main\n\nfunc main() {\n" + "".join("\t" * i + "if true {\n" for i in range(1, n + 1)) + "".join("\t" * i + "}\n" for i in range(n, 0, -1)) + "}\n"


def test_rules_of_a_file_reach_their_checks(spark):
    long = "package main\n\nfunc longFunc(a, b, c int, d string, e float64, f bool) {\n" + "\t_ = 0\n" * 55 + "}\n"
    files = spark.createDataFrame([("a.go", long), ("b.go", deep(5)), ("c.go", deep(2)), ("d.rb", long), ("e.py", "def f(a,b,c):\n    pass\n"), ("f.go", None)], "path string, content string")
    rows = lambda rules: sorted((r.uri, r.rule_id, r.start_line, r.end_line, r.message) for r in S.scan(files, rules).collect())
    said = 'function "longFunc" is 57 lines long (max 50)'
    assert rows(S.AST_RULES) == [("a.go", "AST001", 3, 59, said), ("a.go", "AST004", 3, 59, 'function "longFunc" has 6 parameters (max 5)'), ("b.go", "AST002", 8, 9, "nesting depth 5 exceeds maximum 4")]
    own = parse_rules('{"rules": [{"id": "D", "type": "ast", "ast_check": "nesting-depth", "ast_config": {"max_depth": 1}, "level": "note", "confidence": 1, "message": "m"}, {"id": "P", "type": "ast", "ast_check": "param-count", "ast_config": {"max_params": 2}, "level": "note", "confidence": 1, "message": "m", "languages": ["python"]}, {"id": "X", "pattern": "_ = 0", "level": "note", "confidence": 1, "message": "m"}]}')
    found = rows(own)
    assert [x[:2] for x in found if x[1] != "X"] == [("b.go", "D"), ("c.go", "D"), ("e.py", "P")] and sum(x[1] == "X" for x in found) == 110
    assert R.regex_scan(files, own[:2]).count() == 0 and S.syntax_scan(files, own[2:]).count() == 0 and S.scan(files, []).count() == 0


def test_functions_around_findings_with_their_class(spark):
    files = spark.createDataFrame([("a.go", GO), ("b.py", "class A:\n    def m(self):\n        def inner():\n            x = 1\n        return inner\n")], "path string, content string")
    f = spark.createDataFrame([("r1", 0, "a.go", 4), ("r1", 1, "a.go", 10), ("r2", 0, "a.go", 1), ("r2", 1, "b.py", 4), ("r2", 2, "b.py", 5)], "run_id string, ord long, uri string, start_line int")
    found = A.enclosing(f, S.function_index(files)).select("run_id", "ord", S.qualified_name().alias("q")).collect()
    assert {(r.run_id, r.ord): r.q for r in found} == {("r1", 0): "topLevel", ("r1", 1): "Server.Handle", ("r2", 0): None, ("r2", 1): "A.inner", ("r2", 2): "A.m"}


def test_findings_of_two_runs_do_not_mix(spark):
    rows = [("A", 0, "r", "u", 1, 3, 0.5), ("A", 1, "r", "u", 2, 4, 0.9), ("B", 0, "r", "u", 1, 3, 0.7), ("B", 1, "r", "v", 1, 1, 0.1)]
    f = spark.createDataFrame(rows, "run_id string, ord long, rule_id string, uri string, start_line int, end_line int, confidence double").selectExpr("*", "'instant' as tier")
    assert sorted((r.run_id, r.ord) for r in A.overlap_dedup(f).collect()) == [("A", 1), ("B", 0), ("B", 1)]
    assert A.tier_dedup(f).count() == 4
    index = spark.createDataFrame([("A", "u", "one", 0, 1, 9), ("B", "u", "two", 0, 1, 9)], "run_id string, uri string, name string, fn_ord int, start_line int, end_line int")
    assert {(r.run_id, r.ord): r.function for r in A.enclosing(f, index).collect()} == {("A", 0): "one", ("A", 1): "one", ("B", 0): "two", ("B", 1): None}
