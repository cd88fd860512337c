"""Graphs as JSON: nodes and edges as records, and the node-link form that viewers take."""

from __future__ import annotations

import html
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stellate.functions.symbols import location

ORIGIN = "stellate"


def save_json(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Folders nodes and edges of JSON lines. References are not saved."""
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/edges")


def load_json(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {
        "nodes": spark.read.schema("symbol string, display_name string, file string, line int").json(f"{path}/nodes"),
        "edges": spark.read.schema("kind string, src string, dst string, file string, line int").json(f"{path}/edges"),
    }


def node_link(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row, json: {nodes, links}. For the bounded subgraphs that are drawn."""
    n = nodes.select(F.struct(F.col("symbol").alias("id"), F.coalesce(F.nullif("display_name", F.lit("")), "symbol").alias("label"), F.col("file").alias("source_file"), location(F.col("line")).alias("source_location"), F.lit(ORIGIN).alias("_origin")).alias("x"))
    e = edges.select(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), F.col("kind").alias("relation"), F.col("file").alias("source_file"), location(F.col("line")).alias("source_location"), F.lit(ORIGIN).alias("_origin")).alias("x"))
    one, two = (d.agg(F.sort_array(F.collect_list("x")).alias(k)) for d, k in ((n, "nodes"), (e, "links")))
    return one.crossJoin(two).select(F.to_json(F.struct("nodes", "links"), {"ignoreNullFields": "false"}).alias("json"))  # one row each


def load_node_link(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """nodes and edges, as load_json gives them, of files in the node-link form; a location L7 is line 6, another text none. Each
    file is one value, as the bounded subgraphs are that are exported so."""
    site = "source_file string, source_location string"
    whole = spark.read.option("multiLine", True).schema(f"nodes array<struct<id string, label string, {site}>>, links array<struct<source string, target string, relation string, {site}>>").json(path)
    line = (F.regexp_extract(F.col("x.source_location"), r"^L(\d+)$", 1)).try_cast("int") - 1
    n = whole.select(F.explode("nodes").alias("x")).select(F.col("x.id").alias("symbol"), F.nullif("x.label", "x.id").alias("display_name"), F.col("x.source_file").alias("file"), line.alias("line"))
    e = whole.select(F.explode("links").alias("x")).select(F.col("x.relation").alias("kind"), F.col("x.source").alias("src"), F.col("x.target").alias("dst"), F.col("x.source_file").alias("file"), line.alias("line"))
    return {"nodes": n.distinct(), "edges": e.distinct()}


_VIEWER = """<!DOCTYPE html><meta charset="utf-8"><title>TITLE</title>
<style>html,body{margin:0;height:100%;font:13px sans-serif}canvas{width:100%;height:70%;display:block;background:#fafafa}ul{height:28%;overflow:auto;margin:0}</style>
<canvas id="c"></canvas><ul id="g"></ul><script>
const g = GRAPH, c = document.getElementById("c"), x = c.getContext("2d"), at = new Map();
const name = n => n.label || n.id, hue = {calls: "#4a7", inherits: "#57c", implements: "#c75"};
g.nodes.forEach((n, i) => at.set(n.id, {n, x: Math.cos(i * 2.4) * Math.sqrt(i + 1) * 30, y: Math.sin(i * 2.4) * Math.sqrt(i + 1) * 30, u: 0, v: 0}));
const ps = [...at.values()], ls = g.links.map(l => [at.get(l.source), at.get(l.target), l]).filter(l => l[0] && l[1]);
let held = null, heat = 1, zoom = 1;
function step() {
  for (const p of ps) { p.u -= p.x * 0.002; p.v -= p.y * 0.002; }
  for (let i = 0; i < ps.length; i++) for (let j = i + 1; j < ps.length; j++) {
    const p = ps[i], q = ps[j], a = p.x - q.x || 0.1, b = p.y - q.y || 0.1, k = 600 / (a * a + b * b + 20);
    p.u += a * k * 0.05; p.v += b * k * 0.05; q.u -= a * k * 0.05; q.v -= b * k * 0.05;
  }
  for (const [p, q] of ls) { const a = q.x - p.x, b = q.y - p.y, k = 0.01; p.u += a * k; p.v += b * k; q.u -= a * k; q.v -= b * k; }
  for (const p of ps) { if (p !== held) { p.x += p.u * heat; p.y += p.v * heat; } p.u *= 0.7; p.v *= 0.7; }
  heat = Math.max(0.02, heat * 0.99);
}
function draw() {
  c.width = c.clientWidth; c.height = c.clientHeight;
  x.translate(c.width / 2, c.height / 2); x.scale(zoom, zoom);
  for (const [p, q, l] of ls) {
    const t = Math.atan2(q.y - p.y, q.x - p.x), ex = q.x - 7 * Math.cos(t), ey = q.y - 7 * Math.sin(t);
    x.strokeStyle = x.fillStyle = hue[l.relation] || "#999"; x.beginPath(); x.moveTo(p.x, p.y); x.lineTo(ex, ey); x.stroke();
    x.beginPath(); x.moveTo(ex, ey); x.lineTo(ex - 7 * Math.cos(t - 0.4), ey - 7 * Math.sin(t - 0.4)); x.lineTo(ex - 7 * Math.cos(t + 0.4), ey - 7 * Math.sin(t + 0.4)); x.fill();
  }
  for (const p of ps) { x.fillStyle = p === held ? "#d33" : "#345"; x.beginPath(); x.arc(p.x, p.y, 5, 0, 7); x.fill(); x.fillText(name(p.n), p.x + 8, p.y + 4); }
}
const mouse = e => [(e.offsetX - c.width / 2) / zoom, (e.offsetY - c.height / 2) / zoom];
c.onmousedown = e => { const [a, b] = mouse(e); held = ps.find(p => Math.hypot(p.x - a, p.y - b) < 10) || null; };
c.onmousemove = e => { if (held && e.buttons) { [held.x, held.y] = mouse(e); heat = 1; } };
c.onwheel = e => { e.preventDefault(); zoom = Math.min(5, Math.max(0.1, zoom * (e.deltaY < 0 ? 1.1 : 0.9))); };
for (const l of g.links) { const i = document.createElement("li"); i.textContent = l.source + " \u2192 " + l.target + " (" + l.relation + ")"; document.getElementById("g").append(i); }
(function turn() { step(); draw(); requestAnimationFrame(turn); })();
</script>"""


def viewer_graph(page: Column) -> Column:
    """The node-link graph in a page of viewer_html, as JSON."""
    return F.replace(F.regexp_extract(page, r"(?m)^const g = (.*), c = document\.getElementById", 1), F.lit("<\\/"), F.lit("</"))


def viewer_html(graph: str, title: str = "graph") -> str:
    """A page of its own that draws a node-link graph, by forces between its nodes, and lists its links. Nodes can be
    dragged, the wheel zooms."""
    data = json.dumps(json.loads(graph)).replace("</", "<\\/")
    return _VIEWER.replace("TITLE", html.escape(title), 1).replace("GRAPH", data, 1)
