"""Trees as nested JSON and their statistics, against plain recursion."""

import json
import random

from inkspan.operators import trees

SCHEMA = "doc_id string, node_id string, parent_id string, ord int, title string"


def test_nested_json_of_uneven_trees(spark):
    rng = random.Random(4)
    rows = []
    for doc in "ab":
        rows.append((doc, "0", None, 0, "root of " + doc))
        # A long chain beside nodes with many children.
        rows += [(doc, str(i), str(i - 1 if i < 8 else rng.randrange(i)), i, rng.choice(['say "x"', "back\\slash", "é\n", "", None])) for i in range(1, 40)]
    rows += [("two", "r1", None, 0, "one"), ("two", "r2", None, 1, "other"), ("two", "x", "nowhere", 0, "lost")]

    def nested(doc, node):
        below = sorted((r for r in rows if r[0] == doc and r[2] == node[1]), key=lambda r: (r[3], r[1]))
        return {"title": node[4], "children": [nested(doc, r) for r in below]}

    flat = trees.flatten(spark.createDataFrame(rows, SCHEMA))
    got = {(r.doc_id, r.node_id): json.loads(r.json) for r in trees.nested_json(flat).collect()}
    assert got == {(r[0], r[1]): nested(r[0], r) for r in rows if r[2] is None}

    def depth(tree):
        return 1 + max(map(depth, tree["children"])) if tree["children"] else 0

    stats = {r.doc_id: (r.node_count, r.max_depth) for r in trees.tree_stats(flat).collect()}
    assert stats == {"a": (40, depth(got["a", "0"])), "b": (40, depth(got["b", "0"])), "two": (2, 0)}


def test_no_tree(spark):
    assert trees.nested_json(trees.flatten(spark.createDataFrame([], SCHEMA))).collect() == []
