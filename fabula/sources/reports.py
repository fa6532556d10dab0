"""Reports for people: clusters as text, graphs as a page, models on disk, a log file."""

from __future__ import annotations

import html
import json
import logging
from pathlib import Path

from pyspark.sql import DataFrame

from fabula.operators.clustering import top_phrases
from fabula.operators.graph import Graph
from fabula.operators.model import NarrativeModel


def clusters_to_txt(vocabulary: DataFrame, path: str, topn: int = 10, add_frequency_info: bool = True) -> None:
    """For each cluster its most frequent phrases.  The driver gets topn phrases a cluster."""
    rows = top_phrases(vocabulary, topn).orderBy("cluster", "rank").collect()
    by: dict[int, list[str]] = {}
    for r in rows:
        by.setdefault(r["cluster"], []).append(f"{r['phrase']} ({r['cnt']})" if add_frequency_info else r["phrase"])
    Path(path).write_text("".join(f"Cluster {c}\n{', '.join(p)}\n\n" for c, p in by.items()), encoding="utf-8")


def save_model(model: NarrativeModel, path: str, spark) -> None:
    """A whole NarrativeModel, fitted or not."""
    model.save(path, spark)


def load_model(spark, path: str, backend=None) -> NarrativeModel:
    """A saved model that predicts."""
    return NarrativeModel.load(spark, path, backend)


_PAGE = """<!DOCTYPE html><html><head><meta charset="utf-8"><title>Narratives</title></head><body>
<svg id="g" width="{width}" height="{height}" viewBox="-1.3 -1.3 2.6 2.6" font-size="0.04" font-family="sans-serif">
<defs><marker id="a" viewBox="0 0 10 10" refX="18" refY="5" markerWidth="5" markerHeight="5" orient="auto"><path d="M0 0L10 5L0 10z"/></marker></defs></svg>
<script>
const graph = {data};
const svg = document.getElementById("g"), names = Object.keys(graph.nodes), at = {{}};
names.forEach((n, i) => at[n] = [Math.cos(2 * Math.PI * i / names.length), Math.sin(2 * Math.PI * i / names.length)]);
const add = (kind, attrs, text) => {{ const e = document.createElementNS("http://www.w3.org/2000/svg", kind); for (const k in attrs) e.setAttribute(k, attrs[k]); if (text) e.textContent = text; svg.appendChild(e); }};
graph.edges.forEach(([s, d, label, value], i) => {{ const [a, b] = at[s], [c, e] = at[d], m = 0.7 + 0.05 * (i % 5);
  add("path", {{d: `M${{a}} ${{b}}Q${{(a + c) / 2 * m}} ${{(b + e) / 2 * m}} ${{c}} ${{e}}`, fill: "none", stroke: "#888", "stroke-width": 0.003 * Math.min(value, 8), "marker-end": "url(#a)"}});
  add("text", {{x: (a + c) / 2 * m, y: (b + e) / 2 * m, fill: "#555"}}, label); }});
names.forEach(n => {{ add("circle", {{cx: at[n][0], cy: at[n][1], r: 0.01 + 0.004 * graph.nodes[n], fill: "#36c"}}); add("text", {{x: at[n][0] + 0.03, y: at[n][1]}}, n); }});
</script></body></html>
"""


_CONTROL = """<p><label>{name} <input type="range" min="{least}" max="{most}" step="0.01" value="{value}" oninput="{does}"></label></p>"""
#: Controls of the page: of the layout, and of its looks.
_LAYOUT = _CONTROL.format(name="Spread", least=0.3, most=1.3, value=1, does="document.getElementById('g').setAttribute('viewBox', [-1.3, -1.3, 2.6, 2.6].map(x => x / this.value).join(' '))")
_LOOKS = _CONTROL.format(name="Text", least=0.01, most=0.12, value=0.04, does="document.getElementById('g').setAttribute('font-size', this.value)")


def draw_graph(graph: Graph, output_filename: str = "graph.html", width: str = "1000px", height: str = "1000px", show_buttons: bool = False, only_physics_buttons: bool = False, notebook: bool = False) -> str:
    """Writes a page of its own, without other files, and returns its name, or in a notebook what shows it.

    show_buttons adds controls of layout and looks, only_physics_buttons those of the layout alone."""
    controls = _LAYOUT * (show_buttons or only_physics_buttons) + _LOOKS * (show_buttons and not only_physics_buttons)
    data = json.dumps({"nodes": graph.nodes, "edges": graph.edges}, ensure_ascii=False).replace("</", "<\\/")
    page = _PAGE.format(data=data, width=html.escape(width, quote=True), height=html.escape(height, quote=True))
    Path(output_filename).write_text(page.replace("</body>", controls + "</body>"), encoding="utf-8")
    if notebook:
        from IPython.display import IFrame

        return IFrame(output_filename, width, height)
    return output_filename


class FileLogger:
    """Log file of the driver, with warnings; one at a time, and a new one after close()."""

    _open: FileLogger | None = None

    def __init__(self, file: str, capture_warnings: bool = True, include_root_logger: bool = True, level: str = "INFO") -> None:
        if FileLogger._open is not None:
            raise RuntimeError("a FileLogger is open already")
        self.handler = logging.FileHandler(file, mode="w", encoding="utf-8")
        self.handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
        self.loggers = [logging.getLogger("fabula")] + [logging.getLogger()] * include_root_logger + [logging.getLogger("py.warnings")] * (capture_warnings and not include_root_logger)
        if include_root_logger:
            self.loggers = self.loggers[1:]
        for logger in self.loggers:
            logger.addHandler(self.handler)
            logger.setLevel(level)
        logging.captureWarnings(capture_warnings)
        FileLogger._open = self

    def close(self) -> None:
        for logger in self.loggers:
            logger.removeHandler(self.handler)
        logging.captureWarnings(False)
        self.handler.close()
        FileLogger._open = None


__all__ = ["FileLogger", "clusters_to_txt", "draw_graph", "load_model", "save_model"]
