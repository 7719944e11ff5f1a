"""Problem 2: files whose fields drift, read into one table, with every change listed.

What is compared is schemas, one narrow row per file. Between a file and the last readable
one before it in its feed the tree edit distance of their schemas gives the cheapest script of
adding, deleting, renaming and moving nodes. A leaf kept under its path costs nothing; the
cost of renaming a leaf is what speaks against it, in bits: how the records that both files
hold agree on the two leaves (weighed by how rare the agreeing values are), the names, the
types and the places. Inner nodes cost ``INNER`` each to add, delete or rename, a leaf that
goes to another place than its parent's costs ``MOVE``. The scripts of a feed, chained, give
each file's projection onto the columns, which is applied to its records as they are read.
"""

from __future__ import annotations

import itertools
import json
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codexweave.sources.tables import materialised

#: Names of the same quantity in the files, by column. Fixed values.
COLUMN_NAMES = {
    "recorded_at": ["记录时间"],
    "event": ["事件"],
    "run_id": ["运行编号"],
    "job_dir": ["任务目录"],
    "source_pdf": ["来源PDF"],
    "status": ["状态"],
    "mode": ["模式"],
    "engine": ["引擎"],
    "target_pages": ["目标页数"],
    "processed_pages": ["已处理页数"],
    "output_pages": ["已输出页数"],
    "text_pages": ["有文本页数"],
    "blank_pages": ["空白页数"],
    "low_confidence_pages": ["低置信页数"],
    "failed_pages": ["失败页数"],
    "quality_path": ["质量文件"],
    "total_pages": ["PDF总页数", "总页数"],
    "is_sample": ["是否抽样"],
    "dpi": ["分辨率"],
    "warnings": ["警告"],
    "ocr_device": ["识别设备"],
    "gpu_confirmed": ["图形处理器已确认"],
    "started_at": ["开始时间"],
    "elapsed_seconds": ["已用秒"],
    "avg_seconds_per_page": ["平均每页秒"],
    "eta_seconds": ["预计剩余秒"],
    "updated_at": ["更新时间"],
    "written_at": ["写入时间"],
}
#: The field that identifies a record and is never renamed.
RUN_ID = "运行编号"
#: Bits by which evidence counts, and how many a rename must gather. Parameters of the cost.
SAME_NAME, OTHER_NAME, SAME_LEAF, LIKE_NAME, SAME_TYPE, SAME_PLACE = 12.0, -8.0, 8.0, 6.0, 1.0, 2.0
DISAGREE, ACCEPT = -5.0, 3.0
#: Bits that an inner node costs which is added, deleted or renamed, and a leaf that is moved.
INNER, MOVE = 0.5, 0.5


def _fold(name: str) -> str:
    return re.sub(r"[\W_]+", "", name).casefold()


_COLUMN_OF = {_fold(n): c for c, names in COLUMN_NAMES.items() for n in [c, *names]}


@lru_cache(maxsize=4096)
def column_of(name: str) -> str | None:
    """The column a name stands for: a known name, or one that holds or is held by only one column's names."""
    name = _fold(name)
    if name in _COLUMN_OF:
        return _COLUMN_OF[name]
    holding = {c for n, c in _COLUMN_OF.items() if n in name} if len(name) > 1 else set()
    held = {c for n, c in _COLUMN_OF.items() if name in n} if len(name) > 2 else set()
    return min(holding or held) if len(holding or held) == 1 else None


def _leaves(node: dict, prefix: str = "") -> Iterator[tuple[str, object]]:
    for name, value in node.items():
        path = f"{prefix}.{name}" if prefix else name
        if isinstance(value, dict):
            yield from _leaves(value, path)
        else:
            yield path, value


def _kind_of(value: object) -> str:
    for cls, name in ((bool, "boolean"), (int, "int"), (float, "double"), (str, "string")):
        if isinstance(value, cls):
            return name
    return "list"


def plain(value: object) -> str:
    """A value without its type: 15, 15.0, " 15" and "15页" agree, and so does a list of just one."""
    if isinstance(value, list):
        if len(value) == 1:
            return plain(value[0])
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float) and math.isfinite(value):
        return repr(int(value)) if value == int(value) else repr(value)
    if isinstance(value, str):
        number = re.fullmatch(r"\s*(-?\d{1,15})(?:\.0+)?\s*[^\W\d]{0,3}\s*", value)
        return number[1] if number else value.strip()
    return str(value)


def parse(payload: str | None) -> dict | None:
    """The object a payload holds, or None where it is cut off, empty, null or no object."""
    try:
        node = json.loads(payload) if payload else None
    except (ValueError, RecursionError):
        return None
    return node if isinstance(node, dict) else None


def shown(value: object) -> str:
    """A leaf's value as text, in which a column's value is read."""
    if isinstance(value, list):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, float):
        return plain(value)
    return str(value).lower() if isinstance(value, bool) else str(value)


def run_of(found: list[tuple[str, object]]) -> str | None:
    """The id by which a record is known in the file before, too."""
    return next((str(v) for p, v in found if v is not None and p.rpartition(".")[2] == RUN_ID), None)


def _batch(names: str, types: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names.split())


def _fields(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch's paths by file and type, counted."""
    for batch in batches:
        seen: dict[tuple, list[int]] = {}
        for feed, file_no, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            node = parse(payload)
            if node is not None:
                for place, (path, value) in enumerate(_leaves(node)):
                    if value is not None:
                        entry = seen.setdefault((feed, file_no, path, _kind_of(value)), [0, 0])
                        entry[0] += 1
                        entry[1] += place
        yield _batch("feed file_no path type n places", [pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64()], [(*k, *v) for k, v in seen.items()])


def _known_files(raw: DataFrame) -> DataFrame:
    return raw.where(F.col("feed").isNotNull() & F.col("file_no").isNotNull()).withColumn("file_no", F.col("file_no").cast("int"))


def schemas(raw: DataFrame) -> DataFrame:
    """``feed, file_no, fields``: each readable file's paths with type (by majority), n and place.

    Payloads are read once and counted in their batch; only counts per file and path are
    shuffled. Unreadable payloads add nothing, and a file of such alone has no row.
    """
    rows = _known_files(raw).select("feed", "file_no", "payload").mapInArrow(_fields, "feed string, file_no int, path string, type string, n long, places long")
    by_type = rows.repartition("feed", "file_no").groupBy("feed", "file_no", "path", "type").agg(F.sum("n").alias("n"), F.sum("places").alias("places"))
    by_path = by_type.groupBy("feed", "file_no", "path").agg(
        F.max_by("type", F.struct("n", "type")).alias("type"), F.sum("n").alias("n"), (F.sum("places") / F.sum("n")).alias("place")
    )
    return by_path.groupBy("feed", "file_no").agg(F.array_sort(F.collect_list(F.struct("path", "type", "n", "place"))).alias("fields"))


def boundaries(files: DataFrame) -> DataFrame:
    """``feed, file_no, before, old, new``: the files whose fields differ from the last readable file's before them."""
    before = F.lag("file_no").over(Window.partitionBy("feed").orderBy("file_no"))
    pairs = files.select("feed", "file_no", before.alias("before")).where(F.col("before").isNotNull())
    olds = files.select("feed", F.col("file_no").alias("before"), F.col("fields").alias("old"))
    met = pairs.join(olds, ["feed", "before"]).join(files.withColumnRenamed("fields", "new"), ["feed", "file_no"])
    shape = [F.transform(F.col(side), lambda f: F.struct(f["path"], f["type"])) for side in ("old", "new")]
    return met.where(shape[0] != shape[1]).select("feed", "file_no", "before", "old", "new")


def _paths(side: str) -> Column:
    return F.transform(F.col(side), lambda f: f["path"])


def _leaf(path: Column) -> Column:
    return F.substring_index(path, ".", -1)


def name_priors(changed: DataFrame) -> DataFrame:
    """``leaf, prior``: bits by which a new name is a new name of something rather than new.

    From all feeds: how often the name came where nothing was gone, so that it was added.
    A name that only ever renames comes alone in 2 % of cases (misread files), another in half.
    ``changed`` has the arrays ``gone`` and ``came`` of each boundary.
    """
    seen = changed.select((F.size("gone") == 0).alias("alone"), F.explode("came").alias("path"))
    counts = seen.groupBy(_leaf(F.col("path")).alias("leaf")).agg(F.count("*").alias("n"), F.count_if("alone").alias("alone"))
    alone, rest = math.log2(0.02 / 0.5), math.log2(0.98 / 0.5)
    bits = F.col("alone") * alone + (F.col("n") - F.col("alone")) * rest
    return counts.select("leaf", F.least(F.greatest(bits, F.lit(-6.0)), F.lit(3.0)).alias("prior"))


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The values of the wanted paths of each record, without their types."""
    pair = pa.list_(pa.struct([("path", pa.string()), ("plain", pa.string())]))
    for batch in batches:
        rows = []
        for feed, at, is_old, wanted, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            node = parse(payload)
            if node is not None:
                found = list(_leaves(node))
                wanted = set(wanted)
                rows.append((feed, at, run_of(found), is_old, [{"path": p, "plain": plain(v)} for p, v in found if v is not None and p in wanted]))
        yield _batch("feed at run is_old held", [pa.string(), pa.int32(), pa.string(), pa.bool_(), pair], rows)


def rename_evidence(raw: DataFrame, changed: DataFrame) -> DataFrame:
    """``feed, file_no, seen``: of each boundary with both gone and new leaves, the records it shares.

    ``seen`` has, for each new leaf of each record that both files hold, the record's gone
    leaves, the new leaf's value and how often the new file has that value. Records meet by
    run id and values by value, so no file's rows are ever gathered; a file's few shared
    records are.
    """
    both = changed.where((F.size("gone") > 0) & (F.size("came") > 0))
    wanted = both.select("feed", F.col("before").alias("file_no"), F.col("file_no").alias("at"), F.lit(True).alias("is_old"), F.col("gone").alias("wanted")).unionByName(
        both.select("feed", "file_no", F.col("file_no").alias("at"), F.lit(False).alias("is_old"), F.col("came").alias("wanted"))
    )
    rows = _known_files(raw).select("feed", "file_no", "payload").join(wanted, ["feed", "file_no"]).select("feed", "at", "is_old", "wanted", "payload")
    held = materialised(rows.mapInArrow(_held, "feed string, at int, run string, is_old boolean, held array<struct<path:string,plain:string>>"), "drift-held")
    key = ["feed", "at"]
    values = held.where("NOT is_old").select(*key, F.explode("held").alias("h")).groupBy(*key, F.col("h").alias("h")).agg(F.count("*").alias("same"))
    met = held.where("run IS NOT NULL").groupBy(*key, "run").agg(F.min(F.when(F.col("is_old"), F.col("held"))).alias("olds"), F.min(F.when(~F.col("is_old"), F.col("held"))).alias("news"))
    shared = met.where("size(olds) > 0 AND size(news) > 0").select(*key, "olds", F.explode("news").alias("h"))
    weighed = shared.join(values, [*key, "h"])
    return weighed.groupBy("feed", F.col("at").alias("file_no")).agg(F.collect_list(F.struct("olds", F.col("h").alias("new"), "same")).alias("seen"))


def _letters(name: str) -> set[str]:
    name = _fold(name)
    return {name[i : i + 2] for i in range(len(name) - 1)} or {name}


def rename_bits(old: tuple, new: tuple, seen: tuple[int, float] | None) -> float:
    """What speaks for ``new`` carrying the quantity of ``old``.

    ``old`` is (path, type, place), ``new`` the same with the prior of its name.
    """
    (a, ta, pa, *_), (b, tb, pb, prior) = old, new
    la, lb = a.rpartition(".")[2], b.rpartition(".")[2]
    ca, cb = column_of(la), column_of(lb)
    bits = prior + (seen[1] if seen else 0.0)
    if la == lb:
        bits += SAME_LEAF
    elif ca and cb:
        bits += SAME_NAME if ca == cb else OTHER_NAME
    else:
        x, y = _letters(la), _letters(lb)
        bits += LIKE_NAME * len(x & y) / min(len(x), len(y))
    bits += SAME_TYPE * (ta == tb)
    return bits + SAME_PLACE * math.exp(-abs(pa - pb))


def cheapest_pairs(gain: list[list[float]]) -> list[tuple[int, int]]:
    """Pairs (row, column) of greatest total gain, each at most once, only gains above 0."""
    n, m = len(gain), len(gain[0]) if gain else 0
    size = max(n, m)
    cost = [[-max(0.0, gain[i][j]) if i < n and j < m else 0.0 for j in range(size)] for i in range(size)]
    u, v, match = [0.0] * (size + 1), [0.0] * (size + 1), [0] * (size + 1)
    for i in range(1, size + 1):  # shortest augmenting paths
        match[0], j0, way = i, 0, [0] * (size + 1)
        least, used = [math.inf] * (size + 1), [False] * (size + 1)
        while match[j0]:
            used[j0], delta, j1 = True, math.inf, 0
            for j in range(1, size + 1):
                if not used[j]:
                    now = cost[match[j0] - 1][j - 1] - u[match[j0]] - v[j]
                    if now < least[j]:
                        least[j], way[j] = now, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(size + 1):
                if used[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    return [(match[j] - 1, j - 1) for j in range(1, size + 1) if 0 < match[j] <= n and j <= m and gain[match[j] - 1][j - 1] > 0]


class Node:
    """A node of a schema's tree; a leaf has its path."""

    def __init__(self, label: str, path: str | None = None) -> None:
        self.label, self.path, self.children = label, path, []

    def leaves(self) -> Iterator[str]:
        return iter([self.path]) if self.path is not None else itertools.chain.from_iterable(c.leaves() for c in self.children)


def tree_of(paths: list[str]) -> Node:
    """The tree of dotted paths."""
    root, inner = Node(""), {}
    for path in paths:
        node, names = root, path.split(".")
        for depth in range(1, len(names)):
            prefix = tuple(names[:depth])
            if prefix not in inner:
                inner[prefix] = Node(names[depth - 1])
                node.children.append(inner[prefix])
            node = inner[prefix]
        node.children.append(Node(names[-1], path))
    return root


def tree_mapping(old: Node, new: Node, gain: dict[tuple[str, str], float]) -> tuple[float, list[tuple[str, str]]]:
    """Gain in bits and leaf pairs of the best mapping of two trees, with the order of children free.

    The gain of a mapping is what its script saves against deleting the old tree and adding
    the new one. Subtrees map into subtrees (constrained tree edit distance), so the children
    of two nodes are paired by an assignment, and a node may be added or deleted above one
    that is kept.
    """
    told: dict[tuple[int, int], tuple[float, list]] = {}

    def within(a: Node, b: Node) -> tuple[float, list]:
        """Best mapping of the children of ``a`` into those of ``b``."""
        best = [[subtrees(x, y) for y in b.children] for x in a.children]
        pairs = cheapest_pairs([[cell[0] for cell in row] for row in best])
        return sum(best[i][j][0] for i, j in pairs), [p for i, j in pairs for p in best[i][j][1]]

    def subtrees(a: Node, b: Node) -> tuple[float, list]:
        key = (id(a), id(b))
        if key not in told:
            if a.path is not None and b.path is not None:
                told[key] = (gain[a.path, b.path], [(a.path, b.path)])
            else:
                choices = [subtrees(a, c) for c in b.children] + [subtrees(c, b) for c in a.children]
                if a.path is None and b.path is None:
                    inside = within(a, b)
                    choices.append((inside[0] + (2 if a.label == b.label else 1) * INNER, inside[1]))
                told[key] = max(choices, key=lambda c: c[0])
        return told[key]

    return within(old, new)


def renamed_leaves(gone: list[str], came: list[str], gain: dict[tuple[str, str], float]) -> dict[str, str]:
    """New path to old path of the cheapest script's renamed and moved leaves.

    The tree mapping leaves out leaves that went to another place than their siblings; these
    are moved where that costs less than deleting and adding. Where moving all freely costs
    less than that, the script is the free one.
    """
    if not gone or not came:
        return {}
    saved, pairs = tree_mapping(tree_of(gone), tree_of(came), gain)
    pairs = [p for p in pairs if gain[p] > 0]
    left, right = [a for a in gone if a not in {p[0] for p in pairs}], [b for b in came if b not in {p[1] for p in pairs}]
    moved = [(left[i], right[j]) for i, j in (cheapest_pairs([[gain[a, b] - MOVE for b in right] for a in left]) if left and right else [])]
    saved = sum(gain[p] for p in pairs) + sum(gain[p] - MOVE for p in moved)
    cost = {(a, b): 0.0 if a.rpartition(".")[0] == b.rpartition(".")[0] else MOVE for a, b in gain}
    free = [(gone[i], came[j]) for i, j in cheapest_pairs([[gain[a, b] - cost[a, b] for b in came] for a in gone])]
    if sum(gain[p] - cost[p] for p in free) > saved:
        return {b: a for a, b in free}
    return {b: a for a, b in pairs + moved}


def edit_script(old: dict[str, tuple], new: dict[str, tuple], seen: dict[tuple[str, str], tuple[int, float]]) -> list[tuple[str, str, str | None]]:
    """Cheapest changes (field_name, change_kind, old path) between two files' trees.

    A leaf kept under its path costs nothing, deletions and insertions cost alike, and a
    rename or move costs less than both as far as its evidence goes beyond ``ACCEPT`` bits.
    """
    gone, came = sorted(set(old) - set(new)), sorted(set(new) - set(old))
    pairs = renamed_leaves(gone, came, {(a, b): rename_bits((a, *old[a]), (b, *new[b]), seen.get((a, b))) - ACCEPT for a in gone for b in came})
    changes: list[tuple[str, str, str | None]] = []
    for path in sorted(new):
        was = path if path in old else pairs.get(path)
        if was is None:
            changes.append((path, "added", None))
            continue
        if was != path:
            changes.append((path, "renamed", was))
        if old[was][0] != new[path][0]:
            changes.append((path, "retyped", was))
    return changes + [(path, "removed", path) for path in gone if path not in pairs.values()]


def agreement(seen: list[dict], total: dict[str, int]) -> dict[tuple[str, str], tuple[int, float]]:
    """(shared records, bits) of each old and new leaf: how their values agree, weighed by their rarity."""
    out: dict[tuple[str, str], list] = defaultdict(lambda: [0, 0.0])
    for row in seen:
        new = row["new"]
        rarity = -math.log2((row["same"] + 1) / (total[new["path"]] + 2))
        for leaf in row["olds"]:
            entry = out[leaf["path"], new["path"]]
            entry[0] += 1
            entry[1] += rarity if leaf["plain"] == new["plain"] else DISAGREE
    return {k: tuple(v) for k, v in out.items()}


CHANGES = "feed string, file_no int, field_name string, change_kind string, old_name string"


def _scripts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            priors = {p["leaf"]: p["prior"] for p in r["priors"] or ()}
            old = {f["path"]: (f["type"], f["place"]) for f in r["old"]}
            new = {f["path"]: (f["type"], f["place"], priors.get(f["path"].rpartition(".")[2], 0.0)) for f in r["new"]}
            seen = agreement(r["seen"], {f["path"]: f["n"] for f in r["new"]}) if r["seen"] else {}
            rows += [(r["feed"], r["file_no"], *change) for change in edit_script(old, new, seen)]
        yield _batch("feed file_no field_name change_kind old_name", [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()], rows)


def changes(raw: DataFrame, files: DataFrame) -> DataFrame:
    """CHANGES of each file against the last readable one before it in its feed; ``files`` as from ``schemas``.

    A file without such has no changes; repeated rows change nothing; a field that is null
    throughout a file is not one of its fields.
    """
    gone, came = F.array_except(_paths("old"), _paths("new")), F.array_except(_paths("new"), _paths("old"))
    changed = materialised(boundaries(files).withColumn("gone", gone).withColumn("came", came), "drift-changed")
    named = changed.where("size(gone) > 0").select("feed", "file_no", F.explode("came").alias("path")).withColumn("leaf", _leaf(F.col("path")))
    priors = named.join(name_priors(changed), "leaf").groupBy("feed", "file_no").agg(F.collect_list(F.struct("leaf", "prior")).alias("priors"))
    told = changed.join(priors, ["feed", "file_no"], "left").join(rename_evidence(raw, changed), ["feed", "file_no"], "left")
    return told.select("feed", "file_no", "old", "new", "priors", "seen").mapInArrow(_scripts, CHANGES)


def found_changes(raw: DataFrame) -> DataFrame:
    """``feed, file_no, field_name, change_kind`` of every change in ``raw_records``."""
    return changes(raw, materialised(schemas(raw), "drift-files")).select("feed", "file_no", "field_name", "change_kind")


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The field each path stands for, as the place where it first came up, files in order within their feed."""
    feed, roots = None, {}
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            if r["feed"] != feed:
                feed, roots = r["feed"], {}
            was = {c["path"]: c["old"] for c in r["renames"] or ()}
            roots = {path: roots.get(was.get(path, path), f"{r['file_no']}:{path}") for path in r["paths"]}
            rows += [(feed, r["file_no"], path, root, column_of(path.rpartition(".")[2])) for path, root in roots.items()]
        yield _batch("feed file_no path root column", [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()], rows)


def projections(files: DataFrame, scripts: DataFrame) -> DataFrame:
    """``feed, file_no, projection``: pairs of path and column where each file keeps the columns of its kind.

    A field has the column that the first known of its names along its renames stands for;
    fields of no known column have none. Files of a feed are taken in order, one narrow row
    each, and only the fields of the last one are kept in memory.
    """
    renames = scripts.where("change_kind = 'renamed'").groupBy("feed", "file_no").agg(F.collect_list(F.struct(F.col("field_name").alias("path"), F.col("old_name").alias("old"))).alias("renames"))
    rows = files.select("feed", "file_no", _paths("fields").alias("paths")).join(renames, ["feed", "file_no"], "left")
    rooted = materialised(
        rows.repartition("feed").sortWithinPartitions("feed", "file_no").mapInArrow(_roots, "feed string, file_no int, path string, root string, column string"), "drift-roots"
    )
    named = rooted.where("column IS NOT NULL").groupBy("feed", "root").agg(F.min_by("column", F.struct("file_no", "path")).alias("column"))
    told = rooted.drop("column").join(named, ["feed", "root"])
    return told.groupBy("feed", "file_no").agg(F.collect_list(F.struct("path", "column")).alias("projection"))


def _project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each readable record's values by column; of two fields for one column the first by place counts."""
    for batch in batches:
        rows = []
        for *head, projection, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            node = parse(payload)
            if node is None or projection is None:
                if node is not None:
                    rows.append((*head, []))
                continue
            columns = {p["path"]: p["column"] for p in projection}
            values: dict[str, str] = {}
            for path, value in _leaves(node):
                if value is not None and path in columns:
                    values.setdefault(columns[path], shown(value))
            rows.append((*head, list(values.items())))
        yield _batch("record_id feed file_no line_no received_at v", [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.timestamp("us"), pa.map_(pa.string(), pa.string())], rows)


def _numeral(value: Column) -> Column:
    """A number without the blanks, unit or decimal zeros around it."""
    return F.trim(F.regexp_replace(value, r"(?U)^\s*(-?\d{1,15})(\.0+)?\s*[\p{L}]{0,3}\s*$", "$1"))


def consistent_table(raw: DataFrame, kind: str, like: DataFrame) -> DataFrame:
    """Every readable record of ``kind`` with the columns of ``like``, whatever its file's fields.

    One row per stored row; adds record_id, feed, file_no and line_no. A value that cannot be read as its column's
    type, or that the record has not, is null; columns the files never carry stay null.
    job_key is read off the end of job_dir where the record has one.
    """
    mine = raw.where(F.col("kind") == kind)
    files = materialised(schemas(mine), "drift-files")
    told = projections(files, changes(mine, files))
    received = F.col("received_at").cast("timestamp_ntz") if "received_at" in raw.columns else F.lit(None).cast("timestamp_ntz")
    placed = _known_files(mine).withColumn("received_at", received).join(told, ["feed", "file_no"], "left")
    rows = placed.select("record_id", "feed", "file_no", F.col("line_no").cast("int").alias("line_no"), "received_at", "projection", "payload").mapInArrow(
        _project, "record_id long, feed string, file_no int, line_no int, received_at timestamp_ntz, v map<string,string>"
    )
    columns = [F.col(c) for c in ("record_id", "feed", "file_no", "line_no")]
    for field in like.schema.fields:
        if field.name in ("record_id", "feed", "file_no", "line_no", "received_at"):
            columns += [F.col("received_at")] if field.name == "received_at" else []
            continue
        text = F.try_element_at("v", F.lit(field.name))
        one = F.coalesce(F.get(F.from_json(text, "array<string>"), 0), text)
        if field.dataType.simpleString() in ("int", "bigint", "double"):
            one = _numeral(one)
        if field.name == "job_key":
            column = F.regexp_extract(F.try_element_at("v", F.lit("job_dir")), r"__(job-[^/]+)$", 1)
            column = F.when(column != "", column)
        elif field.dataType.simpleString() == "array<string>":
            column = F.coalesce(F.from_json(text, "array<string>"), F.when(text.isNotNull(), F.array(text)))
        else:
            column = one.try_cast(field.dataType)
        columns.append(column.alias(field.name))
    return rows.select(*columns)
