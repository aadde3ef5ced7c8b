"""A synthetic recorded board, written for tests."""

import json

CONFIG = """
name: harbour
start_urls: ["https://harbour.example/jobs?page=1"]
base_url: https://harbour.example
list:
  item_selector: "div.card"
  url: "a.open::attr(href)"
  fields:
    title: "h2::text"
    company: "span.firm::text"
    location: "span.place::text"
    salary: "span.pay::text"
    summary: "p.short::text"
    tags: "ul.tags li::text"
    posted_at: "time::attr(datetime)"
detail:
  remove: "script, style, a.apply"
  fields:
    title: "h1::text"
    company: "span.firm::text"
    description: "div.body::html"
    location: "div.facts span.place::text"
    employment_type: "div.facts span.kind::text"
    salary: "div.facts span.pay::text"
    tags: "ul.skills li::text"
pagination:
  max_pages: 2
  next_selector: "a.next"
"""

LIST1 = """<html><body>
<div class="card"><h2>Pilot</h2><span class="firm">North &amp; Co</span><a class="open" href="/jobs/1">go</a><time datetime="2026-03-01">x</time><ul class=tags><li>Boats, Radio<li>Night</ul></div>
<div class="card wide"><h2>Cook</h2><span class="firm">Galley</span><span class="place">Remote (EU)</span><a class="open" href="/jobs/2">go</a><span class="pay">$50k - $60k</span></div>
<div class="card"><h2>Ghost</h2><span class="firm">Nobody</span><a class="open" href="https://harbour.example/jobs/3">go</a></div>
<div class="card ad">Buy rope <a href="/ads/1">now</a></div>
<div class="card"><h2>Elsewhere</h2><span class="firm">Away</span><a class="open" href="https://other.example/jobs/9">go</a></div>
<a class="next" href="/jobs?page=2">next</a></body></html>"""
LIST2 = """<div class="card"><h2>Diver</h2><span class="firm">Deep</span><a class="open" href="/jobs/4#top">go</a></div>
<div class="card"><h2>Again</h2><span class="firm">North</span><a class="open" href="/jobs/1">go</a></div>"""
DETAIL = {
    "/jobs/1": '<h1>Harbour Pilot</h1><span class=firm>North &amp; Co</span><div class=facts><span class=place>Oslo</span><span class=kind>Full time</span><span class=pay>&euro;85,000 &ndash; &euro;105,000</span></div><div class=body><p>Steer ships.</p><script>bad()</script><p>Mail a@b.example or +47 22 33 44 55.</p><a class=apply href=#>Apply</a></div><ul class=skills><li>Boats<li>Radar</ul>',
    "/jobs/2": "<h1>Ship Cook</h1><span class=firm>Galley</span><div class=body>Cook &amp;lt;well&amp;gt;.<br>Contract work.</div>",
    "/jobs/4": "<p>no headings</p>",
}


def write(folder):
    base = "https://harbour.example"
    pages = [(f"{base}/jobs?page=1", "l1.html", "list", LIST1), (f"{base}/jobs?page=2", "l2.html", "list", LIST2)]
    pages += [(f"{base}{u}", f"d{u[-1]}.html", "detail", t) for u, t in DETAIL.items()]
    for _, name, _, text in pages:
        (folder / name).write_text(text, encoding="utf-8")
    (folder / "board.yml").write_text(CONFIG, encoding="utf-8")
    listed = [{"url": u, "file": n, "kind": k, "base_url": base} for u, n, k, _ in pages]
    (folder / "manifest.json").write_text(json.dumps({"config": "board.yml", "pages": listed}), encoding="utf-8")
    return str(folder)
