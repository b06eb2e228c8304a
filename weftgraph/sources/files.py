"""Graph file formats. Line formats are read and written by Spark in parallel; documents that hold one
graph as a whole (JSON, GraphML, DOT) are read by Spark as whole texts and taken apart per document."""

from __future__ import annotations

import json
import re
from typing import NamedTuple
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.errors import JSONDeserializationError, JSONSerializationError
from weftgraph.graph import Graph, Weight, condition, number, weight_column

MAP = "map<string,string>"


def _text(spark: SparkSession, path: str, compression: str | None = None) -> str:
    """One document, through Spark's readers, so any store that they open will do; gzip by its first bytes, or by ``compression``."""
    import gzip

    got = spark.read.format("binaryFile").load(path).select("content").head()
    if got is None:
        raise FileNotFoundError(path)
    raw = bytes(got[0])
    if compression not in (None, "gzip"):
        raise ValueError(f"unknown compression {compression}")
    return (gzip.decompress(raw) if compression == "gzip" or raw[:2] == b"\x1f\x8b" else raw).decode()


def _write(spark: SparkSession, path: str, text: str, compression: str | None = None) -> None:
    """One document as a single file through Hadoop's file systems."""
    import gzip

    raw = text.encode()
    if compression == "gzip" or path.endswith((".gz", ".graphmlz")):
        raw = gzip.compress(raw)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(raw))
    finally:
        out.close()


def _graph(spark, nodes: list[tuple], edges: list[tuple], directed: bool, multigraph: bool = True, attrs=None, kind: str = MAP) -> Graph:
    V = spark.createDataFrame(nodes, f"id bigint, payload {kind}")
    E = spark.createDataFrame([(i, *e) for i, e in enumerate(edges)], f"eid bigint, src bigint, dst bigint, payload {kind}")
    return Graph(V, E, directed, multigraph, attrs)


# --- edge lists --------------------------------------------------------------------------------


def read_edge_list(spark: SparkSession, path: str, comment: str | None = None, deliminator: str | None = None, labels: bool = False, directed: bool = False, multigraph: bool = True, allow_self_loops: bool = True) -> Graph:
    """Lines ``u v [weight ...]``; the rest of a line is its payload (string). Labels become dense ids by first appearance."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("n"), F.col("value"))
    if comment:
        lines = lines.select("n", F.expr(f"substring_index(value, {json.dumps(comment)}, 1)").alias("value"))
    lines = lines.where("trim(value) != ''")
    sep = re.escape(deliminator) if deliminator else r"\s+"
    parts = lines.select("n", F.split(F.trim("value"), sep).alias("p"))
    rest = F.when(F.size("p") > 2, F.array_join(F.slice("p", 3, F.size("p")), deliminator or " "))
    E = parts.select(F.col("n").alias("eid"), F.trim(F.get("p", F.lit(0))).alias("a"), F.trim(F.get("p", F.lit(1))).alias("b"), rest.alias("payload"))
    if labels:
        seen = E.select(F.col("a").alias("payload"), (F.col("eid") * 2).alias("k")).union(E.select("b", F.col("eid") * 2 + 1)).groupBy("payload").agg(F.min("k").alias("k"))
        V = number(seen.withColumn("id", F.lit(0)), "id", ["k"]).select("id", "payload")
        names = V.select(F.col("payload").alias("a"), F.col("id").alias("src"))
        E = E.join(names, "a").join(names.select(F.col("a").alias("b"), F.col("src").alias("dst")), "b")
    else:
        E = E.withColumns({"src": F.col("a").cast("bigint"), "dst": F.col("b").cast("bigint")})
        top = E.agg(F.max(F.greatest("src", "dst"))).head()[0]
        V = spark.range(0 if top is None else top + 1).select("id", F.lit(None).cast("string").alias("payload"))
    if not allow_self_loops:
        E = E.where("src != dst")
    E = number(E.select("eid", "src", "dst", "payload"), "eid", ["eid"])
    return Graph.from_edges(E.select("eid", "src", "dst", "payload"), V, directed, multigraph)


def write_edge_list(graph: Graph, path: str, deliminator: str | None = None, weight=None) -> None:
    """A folder of text parts, written in parallel."""
    cols = [F.col("src").cast("string"), F.col("dst").cast("string")]
    if weight is not None:
        cols.append(F.expr(weight).cast("string") if isinstance(weight, str) else weight.cast("string"))
    graph.E.select(F.concat_ws(deliminator or " ", *cols).alias("value")).write.text(path)


# --- MatrixMarket ------------------------------------------------------------------------------


def read_matrix_market_file(spark: SparkSession, path: str) -> Graph:
    """Coordinate text; symmetric kinds give an undirected graph; values are dropped."""
    return _matrix_market(spark, spark.read.text(path).select(F.monotonically_increasing_id().alias("n"), "value"))


def read_matrix_market(spark: SparkSession, contents: str) -> Graph:
    return _matrix_market(spark, spark.createDataFrame(list(enumerate(contents.splitlines())), "n bigint, value string"))


def _matrix_market(spark: SparkSession, lines: DataFrame) -> Graph:
    head = lines.where("value LIKE '%\\%\\%MatrixMarket%'").head()
    if head is None:
        raise ValueError("no MatrixMarket header")
    directed = not re.search(r"symmetric|hermitian", head.value.lower())
    data = lines.where("NOT value LIKE '\\%%' AND trim(value) != ''").select("n", F.split(F.trim("value"), r"\s+").alias("p"))
    size = data.orderBy("n").head()
    rows = int(size.p[0])
    cells = data.where(F.col("n") != size.n).select(F.col("n").alias("eid"), (F.get("p", F.lit(0)).cast("bigint") - 1).alias("src"), (F.get("p", F.lit(1)).cast("bigint") - 1).alias("dst"))
    E = number(cells, "eid", ["eid"]).select("eid", "src", "dst", F.lit(None).cast("double").alias("payload"))
    return Graph(spark.range(rows).select("id", F.lit(None).cast("string").alias("payload")), E, directed)


def matrix_market_lines(graph: Graph, weight: Weight = None) -> DataFrame:
    """pos, value: the lines of the file."""
    n, m = graph.num_nodes(), graph.num_edges()
    kind = "general" if graph.directed else "symmetric"
    pos = number(graph.V.select("id").withColumn("r", F.lit(0)), "r", ["id"])
    e = graph.E.select("eid", "src", "dst", weight_column(weight).alias("w"))
    e = e.join(pos.select(F.col("id").alias("src"), F.col("r").alias("i")), "src").join(pos.select(F.col("id").alias("dst"), F.col("r").alias("j")), "dst")
    i, j = ("i", "j") if graph.directed else (F.greatest("i", "j"), F.least("i", "j"))
    body = e.select((F.col("eid") + 2).alias("pos"), F.concat_ws(" ", (F.col(i) if isinstance(i, str) else i) + 1, (F.col(j) if isinstance(j, str) else j) + 1, F.col("w")).alias("value"))
    head = graph.spark.createDataFrame([(0, f"%%MatrixMarket matrix coordinate real {kind}"), (1, f"{n} {n} {m}")], "pos bigint, value string")
    return head.union(body)


def write_matrix_market(graph: Graph, path: str | None = None, weight: Weight = None) -> str | None:
    """A string, or a folder of ordered text parts."""
    lines = matrix_market_lines(graph, weight)
    if path is None:
        return "\n".join(r.value for r in lines.orderBy("pos").collect()) + "\n"
    lines.orderBy("pos").select("value").write.text(path)
    return None


# --- node-link JSON ----------------------------------------------------------------------------

NODE_LINK = f"struct<directed:boolean,multigraph:boolean,attrs:{MAP},nodes:array<struct<id:bigint,data:{MAP}>>,links:array<struct<source:bigint,target:bigint,id:bigint,data:{MAP}>>>"


def _from_json(spark: SparkSession, frame: DataFrame) -> Graph:
    """``frame`` holds one column ``s`` with the document; nodes and links are taken apart by Spark."""
    try:
        doc = frame.select(F.from_json("s", NODE_LINK, {"mode": "FAILFAST"}).alias("g"))
        head = doc.select("g.directed", "g.multigraph", "g.attrs", F.size("g.nodes").alias("n"), F.expr("size(filter(g.nodes, x -> x.id IS NOT NULL))").alias("named")).head()
    except Exception as err:
        raise JSONDeserializationError(str(err).splitlines()[0]) from err
    if head is None or head.n is None or head.n < 0:
        raise JSONDeserializationError("not a node-link document")
    if 0 < head.named < head.n:
        raise JSONDeserializationError("either all nodes have an id or none")
    V = doc.select(F.posexplode("g.nodes").alias("p", "x")).select(F.coalesce("x.id", F.col("p").cast("bigint")).alias("id"), F.col("x.data").alias("payload"))
    E = doc.select(F.posexplode("g.links").alias("p", "x")).select(F.coalesce("x.id", F.col("p").cast("bigint")).alias("eid"), F.col("x.source").alias("src"), F.col("x.target").alias("dst"), F.col("x.data").alias("payload"))
    return Graph(V, E, bool(head.directed), True if head.multigraph is None else head.multigraph, head.attrs)


def _with_attrs(g: Graph, graph_attrs, node_attrs, edge_attrs) -> Graph:
    """Payloads made of the data maps: Columns, SQL over the row, or callables of the map that return text; ``graph_attrs`` is a callable of the dict."""
    V, E = (df if fn is None else df.withColumn("payload", condition(fn, F.col("payload"), "string")) for df, fn in ((g.V, node_attrs), (g.E, edge_attrs)))
    return g.with_(V, E, attrs=g.attrs if graph_attrs is None else graph_attrs(g.attrs))


def parse_node_link_json(spark: SparkSession, data: str, graph_attrs=None, node_attrs=None, edge_attrs=None) -> Graph:
    """From node-link JSON; payloads are the data maps, or what the three functions make of them."""
    return _with_attrs(_from_json(spark, spark.createDataFrame([(data,)], "s string")), graph_attrs, node_attrs, edge_attrs)


def from_node_link_json_file(spark: SparkSession, path: str, graph_attrs=None, node_attrs=None, edge_attrs=None) -> Graph:
    """The same from a file."""
    return _with_attrs(_from_json(spark, spark.read.text(path, wholetext=True).select(F.col("value").alias("s"))), graph_attrs, node_attrs, edge_attrs)


def node_link_json(graph: Graph, path: str | None = None, graph_attrs: dict[str, str] | None = None, node_attrs: str | None = None, edge_attrs: str | None = None) -> str | None:
    """``node_attrs`` and ``edge_attrs``: SQL for a map<string,string> of the row; without them data is null."""
    if graph_attrs is not None and not all(isinstance(x, str) for kv in graph_attrs.items() for x in kv):
        raise JSONSerializationError("graph attributes must be strings")
    none = F.lit(None).cast(MAP)
    V = graph.V.select(F.struct("id", (F.expr(node_attrs) if node_attrs else none).cast(MAP).alias("data")).alias("x"))
    E = graph.E.select(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), F.col("eid").alias("id"), (F.expr(edge_attrs) if edge_attrs else none).cast(MAP).alias("data")).alias("x"))
    keep = {"ignoreNullFields": "false"}
    nodes = V.orderBy("x.id").select(F.to_json("x", keep).alias("j"))
    links = E.orderBy("x.id").select(F.to_json("x", keep).alias("j"))
    head = json.dumps({"directed": graph.directed, "multigraph": graph.is_multigraph, "attrs": graph_attrs})[:-1]
    text = head + ', "nodes": [' + ", ".join(r.j for r in nodes.collect()) + '], "links": [' + ", ".join(r.j for r in links.collect()) + "]}"
    if path is None:
        return text
    _write(graph.spark, path, text)
    return None


# --- GraphML -----------------------------------------------------------------------------------

#: GraphML types and how they are read.
TYPES = {"boolean": lambda s: s.strip().lower() == "true", "int": int, "long": int, "float": float, "double": float, "string": str}


class GraphMLDomain:
    """What a key is for."""

    Node, Edge, Graph, All = "node", "edge", "graph", "all"


class GraphMLType:
    """How the values of a key are read."""

    Boolean, Int, Long, Float, Double, String = "boolean", "int", "long", "float", "double", "string"


class GraphMLKey(NamedTuple):
    """A key of a GraphML document, for ``write_graphml``."""

    id: str
    domain: str
    name: str
    ty: str
    default: object = None


def read_graphml(spark: SparkSession, path: str, compression: str | None = None) -> list[Graph]:
    """All graphs of a document; payloads are map<string,string> of the values as typed by the keys, with defaults and the file's id."""
    try:
        root = ElementTree.fromstring(_text(spark, path, compression))
    except ElementTree.ParseError as err:
        raise ValueError(f"not XML: {err}") from err
    strip = lambda t: t.rpartition("}")[2]
    keys, out = {}, []
    for k in root:
        if strip(k.tag) == "key":
            kind = k.get("attr.type", "string")
            if kind not in TYPES:
                raise ValueError(f"unknown type {kind}")
            default = next((c.text or "" for c in k if strip(c.tag) == "default"), None)
            keys[k.get("id")] = (k.get("for", "all"), k.get("attr.name", k.get("id")), kind, default)

    def values(element, domain):
        got = {name: str(TYPES[kind](d)) for dom, name, kind, d in keys.values() if d is not None and dom in (domain, "all")}
        for c in element:
            if strip(c.tag) == "data":
                if c.get("key") not in keys:
                    raise ValueError(f"unknown key {c.get('key')}")
                _, name, kind, _ = keys[c.get("key")]
                got[name] = str(TYPES[kind](c.text or ""))
            elif strip(c.tag) in ("port", "graph"):
                raise ValueError(f"{strip(c.tag)} inside {domain} is not supported")
        if element.get("id") is not None and domain != "graph":
            got["id"] = element.get("id")
        return got

    for g in root:
        if strip(g.tag) != "graph":
            continue
        directed = g.get("edgedefault", "undirected") == "directed"
        nodes, edges, index, attrs = [], [], {}, {}
        for x in g:
            kind = strip(x.tag)
            if kind == "node":
                index[x.get("id")] = len(nodes)
                nodes.append((len(nodes), values(x, "node")))
            elif kind == "hyperedge":
                raise ValueError("hyperedges are not supported")
            elif kind == "data":
                attrs[keys[x.get("key")][1]] = x.text or ""
        for x in g:
            if strip(x.tag) == "edge":
                if x.get("directed") is not None and (x.get("directed") == "true") != directed:
                    raise ValueError("mixed edge directions are not supported")
                if x.get("source") not in index or x.get("target") not in index:
                    raise ValueError("an edge names an unknown node")
                edges.append((index[x.get("source")], index[x.get("target")], values(x, "edge")))
        out.append(_graph(spark, nodes, edges, directed, attrs=attrs))
    return out


def write_graphml(graph: Graph, path: str, keys: list[tuple] | None = None, compression: str | None = None) -> None:
    """Payload maps or structs as data elements. ``keys``: GraphMLKey or such tuples; without them they are inferred (d1, d2, ...)."""
    def fields(df):
        t = df.schema["payload"].dataType
        if t.typeName() == "struct":
            return [(f.name, {"bigint": "long", "int": "int", "double": "double", "float": "float", "boolean": "boolean"}.get(f.dataType.simpleString(), "string")) for f in t.fields]
        if t.typeName() == "map":
            return [(r[0], "string") for r in df.select(F.explode(F.map_keys("payload"))).distinct().orderBy(F.col("col")).collect()]
        return []

    if keys is None:
        found = [(d, n, t) for d, df in (("node", graph.V), ("edge", graph.E)) for n, t in fields(df)]
        keys = [(f"d{i}", d, n, t, None) for i, (d, n, t) in enumerate(found, 1)]

    def data(payload, domain):
        have = payload.asDict() if hasattr(payload, "asDict") else payload if isinstance(payload, dict) else {}
        return "".join(f"<data key={quoteattr(i)}>{escape(str(have[n]).lower() if t == 'boolean' else str(have[n]))}</data>" for i, d, n, t, _ in keys if d in (domain, "all") and have.get(n) is not None)

    out = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">']
    for i, d, n, t, default in keys:
        inner = "" if default is None else f"<default>{escape(str(default))}</default>"
        out.append(f'<key id={quoteattr(i)} for="{d}" attr.name={quoteattr(n)} attr.type="{t}">{inner}</key>')
    out.append(f'<graph edgedefault="{"directed" if graph.directed else "undirected"}">')
    out += [f'<node id="n{r.id}">{data(r.payload, "node")}</node>' for r in graph.V.orderBy("id").toLocalIterator()]
    out += [f'<edge source="n{r.src}" target="n{r.dst}">{data(r.payload, "edge")}</edge>' for r in graph.E.orderBy("eid").toLocalIterator()]
    out.append("</graph></graphml>")
    _write(graph.spark, path, "\n".join(out), compression)


# --- DOT ---------------------------------------------------------------------------------------

_token = re.compile(r'\s+|//[^\n]*|/\*.*?\*/|#[^\n]*|(?P<id>"(?:[^"\\]|\\.)*"|[A-Za-z_\x80-\U0010ffff][\w\x80-\U0010ffff]*|-?(?:\.\d+|\d+(?:\.\d*)?))|(?P<op>->|--|[{}\[\];,=:])', re.S)


def from_dot(spark: SparkSession, text: str) -> Graph:
    """Statements for nodes, edges (chains go pairwise) and default attributes; payloads are attribute maps, a node's name under ``label`` unless given."""
    toks, at = [], 0
    while at < len(text):
        m = _token.match(text, at)
        if not m:
            raise ValueError(f"unexpected character at {at}: {text[at]!r}")
        at = m.end()
        if m["id"] is not None:
            s = m["id"]
            toks.append(("id", re.sub(r'\\(["\\])', r"\1", s[1:-1]) if s[0] == '"' else s))
        elif m["op"]:
            toks.append(("op", m["op"]))
    pos = 0

    def peek():
        return toks[pos] if pos < len(toks) else ("end", "")

    def take(value=None):
        nonlocal pos
        t = peek()
        if value is not None and t != ("op", value):
            raise ValueError(f"expected {value!r}, found {t[1]!r}")
        pos += 1
        return t[1]

    strict = peek() == ("id", "strict") and bool(take())
    kind = take().lower()
    if kind not in ("graph", "digraph"):
        raise ValueError("graph or digraph expected")
    directed = kind == "digraph"
    if peek()[0] == "id":
        take()
    nodes: dict[str, dict] = {}
    edges: list[tuple[str, str, dict]] = []
    attrs: dict[str, str] = {}

    def attributes():
        got = {}
        while peek() == ("op", "["):
            take()
            while peek() != ("op", "]"):
                name = take()
                got[name] = "true"
                if peek() == ("op", "="):
                    take()
                    got[name] = take()
                if peek()[1] in (",", ";") and peek()[0] == "op":
                    take()
            take()
        return got

    def body(node_defaults, edge_defaults):
        take("{")
        names: list[str] = []
        while peek() != ("op", "}"):
            if peek()[0] == "end":
                raise ValueError("a brace is missing")
            if peek() == ("op", ";"):
                take()
                continue
            low = peek()[1].lower() if peek()[0] == "id" else ""
            if low in ("node", "edge", "graph") and toks[pos + 1] == ("op", "["):
                take()
                (node_defaults if low == "node" else edge_defaults if low == "edge" else attrs).update(attributes())
                continue
            if peek()[0] == "id" and low != "subgraph" and pos + 1 < len(toks) and toks[pos + 1] == ("op", "="):
                name = take()
                take("=")
                attrs[name] = take()
                continue
            chain = []
            while True:
                if peek() == ("op", "{") or peek()[0] == "id" and peek()[1].lower() == "subgraph":
                    if peek()[0] == "id":
                        take()
                        if peek()[0] == "id":
                            take()
                    chain.append(body(dict(node_defaults), dict(edge_defaults)))
                else:
                    if peek()[0] != "id":
                        raise ValueError(f"unexpected {peek()[1]!r}")
                    name = take()
                    while peek() == ("op", ":"):
                        take()
                        take()
                    nodes.setdefault(name, dict(node_defaults))
                    chain.append([name])
                if peek() not in (("op", "->"), ("op", "--")):
                    break
                if (take() == "->") != directed:
                    raise ValueError("an edge operator does not fit the kind of graph")
            got = attributes()
            if len(chain) == 1 and len(chain[0]) == 1:
                nodes[chain[0][0]].update(got)
            for left, right in zip(chain, chain[1:], strict=False):
                edges.extend((a, b, edge_defaults | got) for a in left for b in right)
            names += [n for c in chain for n in c]
        take("}")
        return list(dict.fromkeys(names))

    body({}, {})
    index = {n: i for i, n in enumerate(nodes)}
    g = _graph(spark, [(index[n], {"label": n} | a) for n, a in nodes.items()], [(index[a], index[b], p) for a, b, p in edges], directed, attrs=attrs)
    return Graph.from_edges(g.E, g.V, directed, False, attrs=attrs) if strict else g


def to_dot(graph: Graph, node_attr: str | None = None, edge_attr: str | None = None, graph_attr: dict[str, str] | None = None, path: str | None = None) -> str | None:
    """``node_attr`` and ``edge_attr``: SQL for a map<string,string> of the row. Lines are formed by Spark."""
    def shown(expr):
        if expr is None:
            return F.lit("")
        pairs = "transform(map_entries({0}), e -> concat(e.key, '=', IF(e.key IN ('label', 'tooltip'), concat('\"', replace(replace(e.value, '\\\\', '\\\\\\\\'), '\"', '\\\\\"'), '\"'), e.value)))".format(expr)
        return F.concat(F.lit(" ["), F.array_join(F.expr(pairs), ", "), F.lit("]"))

    arrow = "->" if graph.directed else "--"
    v = graph.V.select(F.lit(0).alias("k"), F.col("id").alias("i"), F.concat(F.col("id").cast("string"), shown(node_attr), F.lit(" ;")).alias("line"))
    e = graph.E.select(F.lit(1).alias("k"), F.col("eid").alias("i"), F.concat(F.col("src").cast("string"), F.lit(f" {arrow} "), F.col("dst").cast("string"), shown(edge_attr), F.lit(" ;")).alias("line"))
    lines = [r.line for r in v.union(e).orderBy("k", "i").toLocalIterator()]
    head = [f"{k}={val} ;" for k, val in (graph_attr or {}).items()]
    text = "\n".join([("digraph" if graph.directed else "graph") + " {", *head, *lines, "}"]) + "\n"
    if path is None:
        return text
    _write(graph.spark, path, text)
    return None


# --- networkx ----------------------------------------------------------------------------------


def networkx_converter(spark: SparkSession, other, keep_attributes: bool = False) -> Graph:
    """From an object with networkx's ``nodes``/``edges`` views; payloads as strings or attribute maps."""
    index = {n: i for i, n in enumerate(other.nodes)}
    if keep_attributes:
        nodes = [(i, {k: str(v) for k, v in other.nodes[n].items()} | {"__networkx_node__": str(n)}) for n, i in index.items()]
    else:
        nodes = [(i, {"__networkx_node__": str(n)}) for n, i in index.items()]
    edges = [(index[u], index[v], {k: str(x) for k, x in d.items()}) for u, v, d in other.edges(data=True)]
    return _graph(spark, nodes, edges, other.is_directed(), other.is_multigraph())
