"""Labels of fields, relocation with ties at each level, closures over cycles and missing files, owners."""

from fenestra.operators import placement
from fenestra.operators.rules import described
from fenestra.operators.tree import parse

NS = 'xmlns:android="http://schemas.android.com/apk/res/android"'
CASES = {
    "beside, the nearest before": ('<L {ns}><TextView android:text="First"/><TextView android:text="Near"/><EditText android:id="@+id/a"/><TextView android:text="After"/></L>', "/L[1]/EditText[1]", ("/L[1]/TextView[2]", 0, "@id/a")),
    "beside, after": ('<L {ns}><EditText android:id="@id/a"/><TextView android:text="1 : 2"/><TextView android:text="After"/></L>', "/L[1]/EditText[1]", ("/L[1]/TextView[2]", 0, "@id/a")),
    "not hidden, weak, or taken": ('<L {ns}><TextView android:text="Hid" android:visibility="gone"/><TextView android:text="value"/><TextView android:text="T" android:labelFor="@id/z"/><TextView/><EditText android:id="@+id/a"/></L>', "/L[1]/EditText[1]", None),
    "a description will do": ('<L {ns}><x.MyTextView android:contentDescription="Said"/><EditText android:id="@+id/a"/></L>', "/L[1]/EditText[1]", ("/L[1]/MyTextView[1]", 0, "@id/a")),
    "one container above": ('<L {ns}><TextView android:text="Paste"/><ScrollView><EditText android:id="@+id/a"/></ScrollView></L>', "/L[1]/ScrollView[1]/EditText[1]", ("/L[1]/TextView[1]", 1, "@id/a")),
    "two containers above, one": ('<L {ns}><L><TextView android:text="Year"/><T><R><Button android:text="-"/><EditText android:id="@+id/a"/></R></T></L></L>', "/L[1]/L[1]/T[1]/R[1]/EditText[1]", ("/L[1]/L[1]/TextView[1]", 2, "@id/a")),
    "two containers above, ambiguous": ('<L {ns}><L><TextView android:text="Year"/><TextView android:text="Month"/><T><R><EditText android:id="@+id/a"/></R></T></L></L>', "/L[1]/L[1]/T[1]/R[1]/EditText[1]", None),
    "three containers above": ('<L {ns}><TextView android:text="Far"/><A><B><C><EditText android:id="@+id/a"/></C></B></A></L>', "/L[1]/A[1]/B[1]/C[1]/EditText[1]", None),
    "no id": ('<L {ns}><TextView android:text="Near"/><EditText/></L>', "/L[1]/EditText[1]", None),
    "the root": ('<EditText {ns} android:id="@+id/a"/>', "/EditText[1]", None),
}


def test_related_labels(spark):
    docs = spark.createDataFrame([(name, "r", xml.replace("{ns}", NS)) for name, (xml, _, _) in CASES.items()], "doc string, root string, xml string")
    targets = spark.createDataFrame([(name, path) for name, (_, path, _) in CASES.items()], "doc string, path string")
    got = {r.doc: (r.selector, placement.RELATIONS.index(r.relationship), r.required_value) for r in placement.related_labels(targets, described(docs)).collect()}
    assert got == {name: want for name, (_, _, want) in CASES.items() if want}


def test_relocated(spark):
    xml = f'<L {NS}><Button android:id="@+id/a" android:text="x"/><Button android:id="@+id/a" android:text="y"/><EditText android:id="@+id/a" android:text="x"/><EditText android:hint="h"/><Button android:text="y"/></L>'
    nodes = parse(spark.createDataFrame([("d", xml)], "doc string, xml string"), "doc", "xml")
    cases = [
        ("by id and type, tie", "@+id/a", "Button", {}, 2), ("narrowed by attributes", "@id/a", "x.Button", {"text": "y", "layout_width": "1dp"}, 1), ("no attributes agree: all stay", "@id/a", "Button", {"text": "q"}, 2),
        ("by id alone", "@id/a", "", {}, 3), ("id among the attributes", None, "EditText", {"id": "@id/a"}, 1), ("by type alone", None, "EditText", {}, 2), ("by attributes alone", None, "", {"text": "y"}, 2),
        ("nothing known", None, "", {}, 6), ("gone", "@id/b", "Button", {}, 0), ("one by id: attributes aren't asked", "@id/a", "EditText", {"text": "other"}, 1),
    ]
    stored = spark.createDataFrame([(n, "d", i, t, a) for n, i, t, a, _ in cases] + [("no such file", "e", None, "", {})], "name string, doc string, widget_id string, widget_type string, attributes map<string,string>")
    rows = placement.relocated(stored, "name", nodes).collect()
    assert {r.name: r.matches for r in rows} == {**{n: k for n, *_, k in cases}, "no such file": 0}
    assert all(sum(r.name == n for r in rows) == max(1, k) for n, *_, k in cases)
    assert [r.path for r in rows if r.name == "narrowed by attributes"] == ["/L[1]/Button[2]"]


def test_include_closure(spark):
    files = spark.createDataFrame([(p, p != "broken") for p in ("a", "b", "c", "d", "e", "f", "g", "broken")], "path string, ok boolean")
    includes = spark.createDataFrame([("a", "nb"), ("b", "nc"), ("c", "na"), ("d", "na"), ("e", "gone"), ("f", "ne"), ("g", "nbroken"), ("g", "nb"), ("broken", "na")], "path string, name string")
    layouts = spark.createDataFrame([("na", "a"), ("nb", "b"), ("nc", "c"), ("ne", "e"), ("ne", "b"), ("nbroken", "broken")], "name string, path string")
    ids = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("c", "1"), ("e", "5"), ("f", None)], "path string, id string")
    got = {r.start: (r.ids, r.complete) for r in placement.include_closure(files, includes, layouts, ids, files.select("path")).collect()}
    cycle = (["1", "2", "3"], True)
    assert got == {"a": cycle, "b": cycle, "c": cycle, "d": cycle, "e": (["5"], False), "f": (["1", "2", "3", "5"], False), "g": (["1", "2", "3"], False), "broken": ([], False)}


def test_owners(spark):
    found = spark.createDataFrame([("c1", "bar", "/A", "error", None), ("c1", "bar", "/A", "error", "xml_safe"), ("c2", "bar", None, "error", "x"), ("c1", "main", "/B", "error", "x"), ("c1", "lost", "/B", "error", "x")], "code string, file string, selector string, severity string, repairability string")
    closure = spark.createDataFrame([("main", "main"), ("main", "bar"), ("main", "bar"), ("other", "bar"), ("third", "bar")], "screen string, file string")
    screens = spark.createDataFrame([("main", "m", 1.0), ("other", "o", 5.0), ("third", "a", 5.0)], "screen string, name string, score double")
    assert sorted((r.code, r.file, r.owner, r.screens) for r in placement.owned(found, closure, screens).collect()) == [("c1", "bar", "third", 3), ("c1", "main", "main", 1), ("c2", "bar", "third", 3)]
    assert sorted(map(tuple, placement.screen_counts(found, closure).collect())) == [("main", "c1", 2), ("main", "c2", 1), ("other", "c1", 1), ("other", "c2", 1), ("third", "c1", 1), ("third", "c2", 1)]
    own = spark.createDataFrame([("bar", "z", 0.0)], "screen string, name string, score double")
    assert {r.owner for r in placement.owned(found.where("file = 'bar'"), closure.unionByName(spark.createDataFrame([("bar", "bar")], "screen string, file string")), screens.unionByName(own)).collect()} == {"bar"}
