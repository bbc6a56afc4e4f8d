"""Goldens of the full graph, the skeleton and a deepening on a small tree of our own with known counts, and each rule of the ladder."""

import pytest

from codeloom.sources.deepen import call_facts, deepened, resolved_calls, skeleton_graph
from codeloom.sources.repo import facts, full_graph, source_files

TREE = {
    "base.py": "class Root:\n    def run(self, x):\n        return x\n\n    def check(self, x):\n        return x\n\n    def note(self, x):\n        return x\n\n\nclass Extra:\n    def aid(self):\n        return 1\n\n\ndef make_root():\n    return Root()\n\n\ndef split_path(p):\n    return p\n",
    "web.py": "from base import Root, split_path\n\n\nclass Web(Root):\n    def run(self, x):\n        p = split_path(x)\n        return self.step(p)\n\n    def step(self, x):\n        self.check(x)\n        return push(x)\n\n    def again(self, x):\n        self.note(x)\n        return self.run(x)\n\n\ndef push(x):\n    return x\n\n\ndef pull(x):\n    return x\n",
    "tools.py": "from base import split_path\n\n\ndef clean(x):\n    return split_path(x)\n\n\ndef pack(x):\n    return x\n\n\ndef unpack(x):\n    return x\n",
    "session.py": "from web import push\nfrom tools import clean, pack\n\n\nclass Session:\n    def __init__(self):\n        self.h = None\n\n    def get(self, x):\n        return push(pack(clean(x)))\n\n    def post(self, x):\n        return self.h.run(clean(x))\n",
}


def parsed(spark, folder, files):
    for name, text in files.items():
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(text)
    read = source_files(spark, str(folder))
    return facts(read).cache(), call_facts(read).cache()


def counts(df, column):
    return {r[column]: r["count"] for r in df.groupBy(column).count().collect()}


def test_full_skeleton_and_deepening(spark, tmp_path):
    found, calls = parsed(spark, tmp_path, TREE)
    nodes, edges = full_graph(found)
    assert counts(nodes, "type") == {"MODULE": 4, "CLASS": 4, "METHOD": 10, "FUNCTION": 7}
    assert counts(edges, "relation_type") == {"IMPORTS": 4, "CONTAINS": 11, "PARENT_CHILD": 10, "SIBLING": 13, "CALLS": 13, "INHERITS": 1, "OVERRIDES": 1}
    nodes, edges = skeleton_graph(found)
    assert counts(nodes, "type") == {"MODULE": 4, "CLASS": 4, "FUNCTION": 7}
    assert counts(edges, "relation_type") == {"IMPORTS": 4, "CONTAINS": 11, "INHERITS": 1}
    nodes, edges = deepened(found, calls, spark.createDataFrame([("web.py",)], "file string"))
    assert nodes.count() == 3 and counts(edges, "relation_type") == {"PARENT_CHILD": 3, "SIBLING": 2, "CALLS": 4}
    assert {tuple(r) for r in edges.where("relation_type = 'CALLS'").select("src", "dst", "kind", "confidence", "high").collect()} == {
        ("web.py::Web.run", "base.py::split_path", "from_import_alias", 0.85, True),
        ("web.py::Web.run", "web.py::Web.step", "self_method", 1.0, True),
        ("web.py::Web.step", "web.py::push", "same_file_direct_function", 0.9, True),
        ("web.py::Web.again", "web.py::Web.run", "self_method", 1.0, True),
    }


LADDER = {
    "a.py": "class A:\n    def __init__(self):\n        pass\n\n    def go(self):\n        pass\n\n    @classmethod\n    def new(cls):\n        return cls.new()\n\n\nclass Bare:\n    pass\n\n\ndef outer():\n    pass\n\n\ndef far():\n    pass\n",
    "b.py": (
        "import a\nfrom a import A, outer\nfrom a import outer as moved\n\n\ndef give() -> A:\n    return A()\n\n\nclass B(A):\n"
        "    def go(self):\n        super().go()\n        self.part = A()\n        self.part.go()\n\n"
        "    def use(self, x: A, f: Bare):\n        x.go()\n        y = give()\n        y.go()\n        A.go(x)\n        a.outer()\n        moved()\n        far()\n        f()\n        Bare()\n        (1).use2()\n        print(x)\n\n    def use2(self):\n        A.lost()\n"
    ),
}
EXPECTED = {
    ("b.py::give", "a.py::A.__init__", "constructor_init", 0.9),
    ("b.py::B.go", "a.py::A.go", "super_method", 0.95),
    ("b.py::B.go", "a.py::A.__init__", "constructor_init", 0.9),
    ("b.py::B.go", "a.py::A.go", "self_attr_inferred_type", 0.8),
    ("b.py::B.use", "a.py::A.go", "object_inferred_type", 0.78),
    ("b.py::B.use", "b.py::give", "same_file_direct_function", 0.9),
    ("b.py::B.use", "a.py::A.go", "class_method_or_static_method", 0.88),
    ("b.py::B.use", "a.py::outer", "import_alias_attribute", 0.85),
    ("b.py::B.use", "a.py::far", "global_name_fallback", 0.25),
    ("b.py::B.use", "a.py::Bare", "constructor_class", 0.75),
    ("b.py::B.use", "b.py::B.use2", "same_file_attribute_name_fallback", 0.35),
    ("a.py::A.new", "a.py::A.new", "cls_method", 0.95),
}


def test_ladder(spark, tmp_path):
    found, calls = parsed(spark, tmp_path, LADDER)
    nodes, edges = skeleton_graph(found)
    methods, added = deepened(found, calls, found.select("file"))
    got = resolved_calls(calls, nodes.unionByName(methods.drop("owner")), edges.unionByName(added.where("relation_type = 'PARENT_CHILD'").select("src", "dst", "relation_type")))
    assert {tuple(r) for r in got.select("src", "dst", "kind", "confidence").collect()} == EXPECTED


@pytest.mark.parametrize("files", [{"x.py": ""}, {"x.py": "def (:\n"}])
def test_nothing_to_deepen(spark, tmp_path, files):
    found, calls = parsed(spark, tmp_path, files)
    nodes, edges = deepened(found, calls, found.select("file"))
    assert nodes.count() == 0 and edges.count() == 0
