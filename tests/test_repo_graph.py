"""Graph goldens on two small source trees of our own with known structure."""

from codeloom.sources.repo import facts, full_graph, source_files

ANIMALS = {
    "base.py": "class Animal:\n    def speak(self):\n        return ''\n\n    def breathe(self):\n        return 1\n\n\ndef create_animal():\n    return Animal()\n",
    "dog.py": "from base import Animal\n\n\nclass Dog(Animal):\n    def speak(self):\n        return bark()\n\n    def fetch(self):\n        return 2\n\n\ndef bark():\n    return 'w'\n",
    "broken.py": "def (:\n",
    "venv/skip.py": "x = 1\n",
}


def graph(spark, folder, files):
    for name, text in files.items():
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(text)
    nodes, edges = full_graph(facts(source_files(spark, str(folder))))
    return nodes.toPandas(), edges.toPandas()


def test_animals(spark, tmp_path):
    nodes, edges = graph(spark, tmp_path, ANIMALS)
    sound = nodes[nodes["file"] != "broken.py"]
    assert sound["type"].value_counts().to_dict() == {"METHOD": 4, "MODULE": 2, "CLASS": 2, "FUNCTION": 2}
    assert edges["relation_type"].value_counts().to_dict() == {"CONTAINS": 4, "PARENT_CHILD": 4, "SIBLING": 4, "IMPORTS": 1, "CALLS": 1, "INHERITS": 1, "OVERRIDES": 1}
    assert nodes[nodes["file"] == "broken.py"]["parse_error"].notna().all()
    rows = set(edges.itertuples(index=False, name=None))
    assert ("dog.py::Dog.speak", "base.py::Animal.speak", "OVERRIDES") in rows
    assert ("dog.py::Dog.speak", "dog.py::bark", "CALLS") in rows


def test_relative_import_of_a_package(spark, tmp_path):
    _, edges = graph(spark, tmp_path, {"p/__init__.py": "", "p/a.py": "from . import b\nfrom .b import f\n", "p/b.py": "def f():\n    pass\n"})
    assert set(edges[edges["relation_type"] == "IMPORTS"][["src", "dst"]].itertuples(index=False, name=None)) == {("p/a.py::MODULE", "p/__init__.py::MODULE"), ("p/a.py::MODULE", "p/b.py::MODULE")}
