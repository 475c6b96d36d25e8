"""Accessibility trees: structured text, secure pruning, and rows of elements.

Trees come as nested JSON objects (`children`) or as flat arrays with a `depth`. Walking them needs recursion of any depth, which SQL
functions lack: it happens in Arrow UDFs, a tree at a time. Flat arrays become rows in the JVM.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

from .arrow import each

# What accessibility roles stand for.
WINDOW_ROLES = frozenset("AXWindow AXMainWindow AXDocument AXApplication AXStandardWindow".split())
DOMAIN_ROLES = {
    "action": "AXMenu AXMenuItem AXMenuBar AXMenuBarItem AXPopUpButton AXSheet AXDialog AXAlert".split(),
    "nav": "AXToolbar AXTabGroup AXTab AXRadioButton AXHeading AXBanner AXNavigationBar AXTitleBar".split(),
    "body": "AXTextArea AXWebArea AXScrollArea AXTextField AXTable AXList AXOutline".split(),
}
DOMAIN_OF = {role: domain for domain, roles in DOMAIN_ROLES.items() for role in roles}
LOOSE_TEXT_ROLES = frozenset([None, "AXStaticText", "AXApplication", "AXWindow", "AXGroup", "AXSplitGroup"])
TERMINALS = ["Terminal", "iTerm", "iTerm2"]


def nested(value) -> dict | None:
    """A tree as nested objects: flat arrays are folded by depth, several roots get an application above them."""
    if isinstance(value, dict):
        return value
    if not isinstance(value, list):
        return None
    top: dict = {"role": "AXApplication", "children": []}
    branch = [top]
    for item in value:
        if not isinstance(item, dict):
            continue
        depth = item.get("depth")
        depth = max(0, int(depth)) if isinstance(depth, (int, float)) and depth == depth and abs(depth) != float("inf") else 0
        node = {k: v for k, v in item.items() if k not in ("depth", "children")}
        bounds = node.get("bounds")
        if isinstance(bounds, dict):
            node["bounds"] = {"x": bounds.get("x", bounds.get("left")), "y": bounds.get("y", bounds.get("top")), "width": bounds.get("width"), "height": bounds.get("height")}
        if node.get("role") in WINDOW_ROLES and "title" not in node and "text" in node:
            node["title"] = node.pop("text")
        if depth < len(branch):
            del branch[depth + 1 :]
        parent = branch[depth] if depth < len(branch) else top  # a gap in depth starts a new root
        parent.setdefault("children", []).append(node)
        if parent is top:
            del branch[1:]
        branch.append(node)
    roots = top["children"]
    return None if not roots else roots[0] if len(roots) == 1 else top


def parsed(text: str | None) -> dict | None:
    try:
        return nested(json.loads(text)) if text and text.strip() else None
    except (ValueError, RecursionError):  # no JSON, or nested deeper than the parser goes
        return None


def children(node: dict) -> list[dict]:
    found = node.get("children")
    return [c for c in found if isinstance(c, dict)] if isinstance(found, list) else []


def visible(node: dict) -> bool:
    bounds = node.get("bounds") if isinstance(node.get("bounds"), dict) else {}
    sizes = [bounds.get("width"), bounds.get("height")]
    return node.get("onScreen") is not False and node.get("on_screen") is not False and not any(isinstance(s, (int, float)) and s <= 0 for s in sizes)


def text_of(node: dict) -> str:
    return next((node[k].strip() for k in ("value", "text", "title", "description") if isinstance(node.get(k), str) and node[k].strip()), "")


def walk(root: dict) -> Iterator[tuple[dict, str | None, int]]:
    """(node, domain, depth below the nearest window) of every visible node in document order."""
    pending = [(root, None, 0, 0)]
    while pending:
        node, domain, depth, window = pending.pop()
        if not visible(node):
            continue
        role = node.get("role")
        if role in WINDOW_ROLES and role != "AXApplication":
            window = depth
        own = DOMAIN_OF.get(role)
        if own and (own != "body" or domain is None):
            domain = own
        yield node, domain, depth - window
        pending += [(c, domain, depth + 1, window) for c in reversed(children(node))]


def structured(root: dict, window_title: str | None = None) -> dict[str, list[str]]:
    """The tree's lines by domain: window, nav, action and body, each with its tag."""
    out: dict[str, list[str]] = {"window": [], "nav": [], "action": [], "body": []}
    title = (root.get("title") if isinstance(root.get("title"), str) and root.get("title") else window_title or "").strip()
    if visible(root) and title and root.get("role") != "AXApplication":
        out["window"].append(f"[Window] {title}")
    for node, domain, depth in walk(root):
        role, text = node.get("role"), text_of(node)
        if role in WINDOW_ROLES:
            own = node["title"].strip() if isinstance(node.get("title"), str) else ""
            if role != "AXApplication" and own and f"[Window] {own}" not in out["window"]:
                out["window"].append(f"[Window] {own}")
            if text in (title, node.get("title")):
                continue
        if domain is None:
            if role == "AXStaticText" and depth <= 1:
                domain = "nav"
            elif role in LOOSE_TEXT_ROLES:
                domain = "body"
            else:
                continue
        out[domain] += [f"[{domain.capitalize()}] {line}" for line in (x.strip() for x in text.splitlines()) if line]
    if visible(root) and not children(root) and not any(out.values()):
        alone = text_of(root)
        if alone and alone != title:
            out["body"].append(f"[Body] {alone}")
        elif title:
            out["window"].append(f"[Window] {title}")
    return out


DOMAINS = ("window", "nav", "action", "body")


@arrow_udf(StructType([StructField(k, ArrayType(StringType())) for k in DOMAINS]))
def tree_domains(tree: pa.Array, title: pa.Array) -> pa.Array:
    def one(text, window):
        return structured(t, window) if (t := parsed(text)) else dict.fromkeys(DOMAINS, [])

    return each(one, pa.struct([(k, pa.list_(pa.string())) for k in DOMAINS]), tree, title)


def tree_text(tree: Column, title: Column) -> Column:
    """All lines of a tree: window, navigation, actions, body."""
    d = tree_domains(tree, title)
    return F.array_join(F.concat(d["window"], d["nav"], d["action"], d["body"]), "\n")


def rule_kind(app: Column) -> Column:
    return F.when(app.isin(TERMINALS), "terminal").otherwise("generic")


def pruned(value, secure: frozenset[str]):
    """A tree without secure nodes and what is below them. In flat arrays a secure run lasts until the depth is back; nodes without depth inside it go."""
    is_secure = lambda n: isinstance(n.get("role"), str) and n["role"].lower() in secure
    if isinstance(value, list):
        kept, inside = [], None
        for item in value:
            if not isinstance(item, dict):
                continue
            depth = item.get("depth") if isinstance(item.get("depth"), (int, float)) else None
            if inside is not None and (depth is None or depth > inside):
                continue
            inside = None
            if is_secure(item):
                inside = depth if depth is not None else 0
            else:
                kept.append(item)
        return kept
    if not isinstance(value, dict):
        return value
    if is_secure(value):
        return None
    root = dict(value)
    pending = [root]
    while pending:  # nodes are copied before what is below them: no depth is too much
        node = pending.pop()
        if isinstance(node.get("children"), list):
            node["children"] = [dict(c) for c in node["children"] if isinstance(c, dict) and not is_secure(c)]
            pending += node["children"]
    return root


def prune_json(tree: Column, secure_roles: list[str]) -> Column:
    secure = frozenset(r.lower() for r in secure_roles)

    def one(text):
        try:
            value = pruned(json.loads(text), secure) if text else None
            return None if value is None else json.dumps(value, ensure_ascii=False, separators=(",", ":"))
        except (ValueError, RecursionError):
            return None  # what can't be read is not shown

    @arrow_udf(StringType())
    def run(trees: pa.Array) -> pa.Array:
        return each(one, pa.string(), trees)

    return run(tree)


def holds_secure(tree: Column, secure_roles: list[str]) -> Column:
    """Whether any node has a secure role: such trees never fall back to raw text."""
    secure = frozenset(r.lower() for r in secure_roles)

    def any_secure(root: dict | None) -> bool:
        pending = [root] if root else []
        while pending:
            node = pending.pop()
            if isinstance(node.get("role"), str) and node["role"].lower() in secure:
                return True
            pending += children(node)
        return False

    @arrow_udf(BooleanType())
    def run(trees: pa.Array) -> pa.Array:
        return each(lambda t: any_secure(parsed(t)), pa.bool_(), trees)

    return run(tree)


def input_tree(record_tree: Column, frame_tree: Column, text: Column) -> Column:
    """The tree to extract from: the record's, else its frame's, else its text in a tree of one node; blank trees don't count."""
    some = lambda t: F.when(F.trim(t) != "", t)
    return F.coalesce(some(record_tree), some(frame_tree), text_tree(text))


def text_tree(text: Column) -> Column:
    return F.when(text != "", F.to_json(F.struct(F.lit("AXWebArea").alias("role"), text.alias("value"))))


def extracted_text(record_tree: Column, frame_tree: Column, text: Column, title: Column, secure_roles: list[str]) -> Column:
    """The text of a record: from its tree without secure parts, or from its own text where the tree gives none, unless the tree holds secure nodes."""
    raw = input_tree(record_tree, frame_tree, text)
    own = tree_text(prune_json(raw, secure_roles), title)
    return F.when((own != "") | (F.coalesce(text, F.lit("")) == "") | holds_secure(raw, secure_roles), own).otherwise(tree_text(text_tree(text), title))


FLAT = "array<struct<role:string,text:string,depth:int,bounds:struct<left:double,top:double,width:double,height:double>>>"


def element_rows(frames: DataFrame, tree: str = "accessibility_tree_json") -> DataFrame:
    """Rows of elements of flat-array trees: (frame_id, sort_order, role, text, depth, parent_order). A node's parent is the last one before it one level up."""
    rows = frames.select("frame_id", F.posexplode(F.from_json(F.col(tree), FLAT)).alias("sort_order", "n")).select("frame_id", "sort_order", "n.role", "n.text", F.coalesce("n.depth", F.lit(0)).alias("depth"))
    # each row is seen on its own level, and asks the level above for the last row before it
    seen = rows.withColumn("_l", F.explode(F.array(F.struct(F.col("depth").alias("level"), F.lit(True).alias("own")), F.struct((F.col("depth") - 1).alias("level"), F.lit(False).alias("own")))))
    before = W.partitionBy("frame_id", "_l.level").orderBy("sort_order").rowsBetween(W.unboundedPreceding, -1)
    return seen.withColumn("parent_order", F.max(F.when(F.col("_l.own"), F.col("sort_order"))).over(before)).filter("NOT _l.own").drop("_l")


def frame_trees(frames: DataFrame, elements: DataFrame) -> DataFrame:
    """(frame_id, accessibility_tree_json) of frames: rebuilt from the elements of the frame they refer to, or else their own; frames without elements keep what they have."""
    owner = F.coalesce("elements_ref_frame_id", "frame_id")
    trees = tree_of_elements(elements).select(F.col("frame_id").alias("_owner"), F.col("accessibility_tree_json").alias("_tree"))
    out = frames.join(trees, owner == F.col("_owner"), "left")
    return out.select("frame_id", F.coalesce("_tree", "accessibility_tree_json").alias("accessibility_tree_json"))


def tree_of_elements(elements: DataFrame) -> DataFrame:
    """(frame_id, accessibility_tree_json) as flat arrays from rows (frame_id, id, role, text, depth, sort_order), in order."""
    node = F.struct("sort_order", "id", "role", "text", "depth")
    listed = F.transform(F.sort_array(F.collect_list(node)), lambda n: F.struct(n["role"].alias("role"), n["text"].alias("text"), n["depth"].alias("depth")))
    return elements.groupBy("frame_id").agg(F.to_json(listed).alias("accessibility_tree_json"))
