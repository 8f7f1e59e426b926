"""Figure data, a self-contained page, and a local server for it."""

from __future__ import annotations

import http.server
import json
import threading
import webbrowser
from html import escape

from .session import Session, gene_dict


def figure_data(session: Session, weight: float = 0.5, method: str = "ward", use_file_order: bool = False) -> dict:
    """Nested clusters (in display order, or the files'), flat links with whole genes, and groups."""
    whole = session.to_dict()
    genes = whole["genes"]
    loci = {k: {**v, "genes": [genes[g] for g in v["genes"]]} for k, v in whole["loci"].items()}
    clusters = [{**whole["clusters"][c], "loci": [loci[x] for x in whole["clusters"][c]["loci"]]} for c in whole["order"]]
    if not use_file_order:
        clusters = [clusters[i] for i in session.order(method, weight)]
    return {"clusters": clusters, "links": list(whole["links"].values()), "groups": whole["groups"]}


BLANK = {"clusters": [], "links": [], "groups": []}

STYLE = "body{font:14px sans-serif;margin:1em}svg text{font-size:11px}label{margin-right:1em}"
#: Draws clusters as rows of arrows, coloured by group, and links above a threshold as bands between neighbouring rows.
SCRIPT = """
const show = data => {
  const least = +document.getElementById('least').value, best = document.getElementById('best').checked, kind = document.getElementById('kind').value;
  const svg = document.getElementById('figure'), scale = 0.03, row = 90, place = {}, colour = {};
  const palette = i => `hsl(${(i * 137.5) % 360} 60% 60%)`;
  data.groups.forEach((g, i) => g.hidden || g.genes.forEach(x => colour[x] = g.colour || palette(i)));
  let out = '', width = 400;
  data.clusters.forEach((c, i) => {
    let x = 170;
    out += `<text x="5" y="${i * row + 34}">${text(c.name)}</text>`;
    c.loci.forEach(l => {
      out += `<line x1="${x}" x2="${x + (l.end - l.start) * scale}" y1="${i * row + 30}" y2="${i * row + 30}" stroke="#999"/>`;
      l.genes.forEach(g => {
        const a = x + (g.start - l.start) * scale, b = x + (g.end - l.start) * scale, y = i * row + 22;
        place[g.uid] = {a, b, i};
        const p = g.strand === -1 ? `${a},${y + 8} ${Math.min(b, a + 8)},${y} ${b},${y} ${b},${y + 16} ${Math.min(b, a + 8)},${y + 16}` : `${a},${y} ${Math.max(a, b - 8)},${y} ${b},${y + 8} ${Math.max(a, b - 8)},${y + 16} ${a},${y + 16}`;
        out += `<polygon points="${p}" fill="${colour[g.uid] || '#ddd'}" stroke="#444"><title>${text((g.names && g.names[kind]) || g.label)}</title></polygon>`;
      });
      x += (l.end - l.start) * scale + 25;
    });
    width = Math.max(width, x);
  });
  const top = {};
  data.links.forEach(l => { const k = l.query.uid + '~' + (place[l.target.uid] || {}).i; if (!top[k] || top[k].identity < l.identity) top[k] = l; });
  data.links.filter(l => l.identity >= least && (!best || Object.values(top).includes(l))).forEach(l => {
    let p = place[l.query.uid], q = place[l.target.uid];
    if (!p || !q || Math.abs(p.i - q.i) !== 1) return;
    if (p.i > q.i) [p, q] = [q, p];
    out = `<polygon points="${p.a},${p.i * row + 38} ${p.b},${p.i * row + 38} ${q.b},${q.i * row + 22} ${q.a},${q.i * row + 22}" fill="${colour[l.query.uid] || '#888'}" opacity="${0.15 + 0.6 * l.identity}"><title>${l.identity.toFixed(2)}</title></polygon>` + out;
  });
  svg.setAttribute('width', width + 20); svg.setAttribute('height', data.clusters.length * row + 20); svg.innerHTML = out;
};
const text = t => String(t).replace(/[&<>"]/g, c => `&#${c.charCodeAt(0)};`);
const start = data => {
  const kinds = new Set(['label']);
  data.clusters.forEach(c => c.loci.forEach(l => l.genes.forEach(g => Object.keys(g.names || {}).forEach(k => kinds.add(k)))));
  document.getElementById('kind').innerHTML = [...kinds].map(k => `<option>${text(k)}</option>`).join('');
  ['least', 'best', 'kind'].forEach(i => document.getElementById(i).addEventListener('input', () => show(data)));
  document.getElementById('save').addEventListener('click', () => {
    const a = document.createElement('a');
    a.href = URL.createObjectURL(new Blob([document.getElementById('figure').outerHTML], {type: 'image/svg+xml'}));
    a.download = 'figure.svg'; a.click();
  });
  show(data);
};
"""
BODY = '<p><label>Links from <input id="least" type="range" min="0" max="1" step="0.01" value="0.3"></label><label><input id="best" type="checkbox"> best only</label><label>Labels <select id="kind"></select></label><button id="save">Save SVG</button></p><svg id="figure" xmlns="http://www.w3.org/2000/svg"></svg>'


def page(data: dict | None, title: str = "Gene clusters") -> str:
    """A page with the data in it, or one that fetches /data.json."""
    if data is None:
        begin = "fetch('/data.json').then(r => r.json()).then(start);"
    else:
        begin = "start(" + json.dumps(data).replace("</", "<\\/") + ");"
    return f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{escape(title)}</title><style>{STYLE}</style></head><body>{BODY}<script>{SCRIPT}{begin}</script></body></html>'


def save_html(data: dict, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.write(page(data))


def server(data: dict, port: int = 0) -> http.server.ThreadingHTTPServer:
    """A server on this machine only, on a free port unless one is given: / is the page, /data.json the data."""
    routes = {"/": ("text/html; charset=utf-8", page(None)), "/data.json": ("application/json", json.dumps(data))}

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            kind, body = routes.get(self.path, ("text/plain", None))
            self.send_response(404 if body is None else 200)
            self.send_header("Content-Type", kind)
            self.end_headers()
            self.wfile.write((body or "not found").encode())

        def log_message(self, *args) -> None:
            pass

    return http.server.ThreadingHTTPServer(("127.0.0.1", port), Handler)


def serve_html(data: dict, browser: bool = True) -> None:
    """Serves until interrupted."""
    own = server(data)
    if browser:
        threading.Timer(0.5, webbrowser.open, [f"http://127.0.0.1:{own.server_port}/"]).start()
    try:
        own.serve_forever()
    except KeyboardInterrupt:
        own.shutdown()


def plot(data: dict, output: str | None = None) -> None:
    save_html(data, output) if output else serve_html(data)


def plot_clusters(session: Session, output: str | None = None, use_file_order: bool = False) -> None:
    plot(figure_data(session, use_file_order=use_file_order), output)


__all__ = ["BLANK", "figure_data", "gene_dict", "page", "plot", "plot_clusters", "save_html", "serve_html", "server"]
