import pytest

from tallyline.functions import java_source
from tallyline.functions.java_source import SourceError
from tallyline.operators import changes


@pytest.fixture()
def entities(spark):
    """The entities of a text, with their kinds, in text order."""

    def read(text):
        java_source.entities(text)  # unreadable texts are errors here
        return changes.extract_entities(spark.createDataFrame([(text,)], "text string")).orderBy("ordinal").collect()

    return read


@pytest.fixture()
def kinds(entities):
    return lambda text: [(row.entity_type, row.unique_name) for row in entities(text)]


def test_layout_does_not_matter(kinds):
    loose = "class A {\n  int total( )\n  {\n    return   1 ;\n  }\n}"
    assert kinds(loose) == kinds("class A { int total() { return 1; } }")


def test_statements_of_a_method(entities):
    text = """
    class A {
      void run(final Map<String, Integer> m, int... n) throws E {
        int x = n + 50, y;
        List<String> l = load(x);
        for (String s : l) s.trim();
        if (x > 3) { return; } else x++;
        this.size += 4;
        try { go(); } catch (E e) { stop(); } finally { end(); }
        switch (x) { case 1: one(); break; default: other(); }
        again: while (true) { continue again; }
        new Thread(() -> { work(); }).start();
      }
    }"""
    found = [row.entity_type for row in entities(text)]
    assert found == [
        "VARIABLE_DECLARATION_STATEMENT",
        "METHOD_INVOCATION",
        "VARIABLE_DECLARATION_STATEMENT",
        "METHOD_INVOCATION",
        "FOREACH_STATEMENT",
        "RETURN_STATEMENT",
        "THEN_STATEMENT",
        "POSTFIX_EXPRESSION",
        "ELSE_STATEMENT",
        "IF_STATEMENT",
        "ASSIGNMENT",
        "METHOD_INVOCATION",
        "TRY_STATEMENT",
        "METHOD_INVOCATION",
        "CATCH_CLAUSE",
        "METHOD_INVOCATION",
        "FINALLY",
        "SWITCH_CASE",
        "METHOD_INVOCATION",
        "BREAK_STATEMENT",
        "SWITCH_CASE",
        "METHOD_INVOCATION",
        "SWITCH_STATEMENT",
        "CONTINUE_STATEMENT",
        "WHILE_STATEMENT",
        "CLASS_INSTANCE_CREATION",
        "METHOD",
        "CLASS",
    ]
    assert entities(text)[-2].unique_name == "A.run(Map<String,Integer>,int...)"


def test_members_comments_and_strings(kinds):
    text = """package p; import q.R;
    /** About A. */ @Deprecated public class A<T extends B> extends C {
      private String a = "{;/*", b; // both
      static { a = "x"; }
      @Test(timeout = 3) public void check() { assertEquals(1, two('}')); }
      enum Kind { ONE, TWO { int z() { return 2; } }; int k; }
      interface Seen { void now(); }
    }"""
    assert kinds(text) == [
        ("JAVADOC", "/** About A. */"),
        ("ANNOTATION", "@Deprecated"),
        ("FIELD", "A.a : String"),
        ("FIELD", "A.b : String"),
        ("LINE_COMMENT", "// both"),
        ("ASSIGNMENT", 'a = "x";'),
        ("ANNOTATION", "@Test(timeout = 3)"),
        ("METHOD_INVOCATION", "assertEquals(1, two('}'));"),
        ("METHOD", "A.check()"),
        ("FIELD", "A.Kind.k : int"),
        ("CLASS", "A.Kind"),
        ("METHOD", "A.Seen.now()"),
        ("CLASS", "A.Seen"),
        ("CLASS", "A"),
    ]


@pytest.mark.parametrize("text", ["class A { /* open", "class A { void f() {", "class A { } }", "class A { int x = (3; }"])
def test_unbalanced_text_is_an_error(entities, text):
    with pytest.raises(SourceError):
        entities(text)


def test_empty_text_has_nothing(entities):
    assert entities("") == []


def test_depth_is_no_limit(entities):
    arms = " ".join(f"else if (x == {n}) b();" for n in range(5000))
    found = entities("class A { void f(int x) { if (x == 0) a(); " + arms + " } }")
    assert sum(row.entity_type == "IF_STATEMENT" for row in found) == 5001
    assert found[-2].unique_name == "A.f(int)" and found[-2].method_statements == 3 * 5001 + 5000
    blocks = entities("class A { void f() { " + "{" * 5000 + " go(); " + "}" * 5000 + " } }")
    assert [row.entity_type for row in blocks] == ["METHOD_INVOCATION", "METHOD", "CLASS"]
    assert len(entities("".join(f"class A{n} {{ " for n in range(2000)) + "}" * 2000)) == 2000


@pytest.mark.parametrize(
    "parameters, types",
    [("int a[]", "int[]"), ("@Nullable T t", "T"), ('final @X("y") Map<K, V> m, int... n', "Map<K,V>,int..."), ("", "")],
)
def test_parameter_types(entities, parameters, types):
    assert entities(f"class A {{ void f({parameters}) {{}} }}")[0].unique_name == f"A.f({types})"


def test_a_module_declares_nothing_that_counts(kinds):
    assert kinds("/** m */ open module a.b { requires x; exports y; }") == [("JAVADOC", "/** m */")]


def test_only_unbalanced_texts_are_errors():
    base = "class A { @B(1) int x = 3, y; void f(int a) { if (a > 1) { return; } else go(); int z = call(1); } enum E { X, Y; int q; } }"
    for at in range(len(base)):
        for text in (base[:at], base[at:], base[:at] + "}" + base[at:], base[:at] + "(" + base[at:]):
            try:
                java_source.entities(text)
            except SourceError:
                pass
