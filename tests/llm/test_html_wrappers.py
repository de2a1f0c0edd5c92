"""Wrappers: alignment against brute force, extraction against a version without Spark, and pages of odd shape."""

import collections
import random
import time

import numpy as np
import pytest

from tessera.llm import html_wrappers

PAGES = "page_id long, url string, html string"


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(n))


def subsequence_length(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


@pytest.mark.parametrize("cells", [1 << 22, 6])
def test_alignment_is_a_longest_common_subsequence(monkeypatch, cells):
    monkeypatch.setattr(html_wrappers, "CELLS", cells)
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 14))] for _ in "ab")
        pairs = html_wrappers.common(np.array(a, np.int64), np.array(b, np.int64))
        assert all(a[i] == b[j] for i, j in pairs) and len(pairs) == subsequence_length(a, b)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


def test_wrappers_hold_every_page():
    """Slots of a page keep their order and never fall together unless they were folded or aligned to one place."""
    a, _ = html_wrappers.expression("<div><h2>t</h2><p>x</p></div><ul><li>1<li>2<li>3</ul>")
    b, _ = html_wrappers.expression("<div><h2>t</h2></div><table><tr><td>n</table><ul><li>1</ul>")
    wrapper, slots = html_wrappers.merged([a, b])
    assert slots[0][0] == slots[1][0] and slots[0][2] == slots[1][2]  # heading and list entries
    assert len({*slots[0], *slots[1]}) == 4 and '"10p"' in wrapper and '"10table"' in wrapper and '"01li"' in wrapper
    c, _ = html_wrappers.expression("<div class='post one'><p>x</p></div>")
    d, _ = html_wrappers.expression("<div class='post two'><p>y</p></div>")
    assert html_wrappers.merged([c, d])[1][0] == html_wrappers.merged([c, d])[1][1]  # akin by a word of the class
    e, _ = html_wrappers.expression("<div class='comments two'><p>y</p></div>")
    assert len({x[0] for x in html_wrappers.merged([c, e])[1]}) == 2


def test_repeats_of_any_period():
    row = "".join(f"<{t}>x</{t}>" for t in ("h2", "p", "ul", "table", "h3", "pre"))
    once, _ = html_wrappers.expression(row + row)
    often, blocks = html_wrappers.expression(row * 5)
    assert once == often and len({s for s, _, _ in blocks}) == 6
    assert len({s for s, _, _ in html_wrappers.expression(row * 3 + "<hr><h4>x</h4>" + row * 2)[1]}) > 6


def brute(pages, aligned=True):
    """main_text without Spark, all expressions of a host in one part; or each expression by itself."""
    out, hosts = {}, collections.defaultdict(list)
    for page_id, url, page in pages:
        hosts[(url or "").split("/")[2] if url else ""].append((page_id, *html_wrappers.expression(page or "")))
    groups = []
    for rows in hosts.values():
        if aligned:
            groups.append(rows)
        else:
            own = collections.defaultdict(list)
            for r in rows:
                own[r[1]].append(r)
            groups += own.values()
    for rows in groups:
        count = collections.Counter(w for _, w, _ in rows)
        order = sorted(count, key=lambda w: (-count[w], w))
        wrapper, slots = html_wrappers.merged(order)
        slot_of = dict(zip(order, slots))
        distinct = {(w, tuple(b)) for _, w, b in rows}
        texts, seen, stats = collections.Counter(), collections.Counter(), {}
        for w, blocks in distinct:
            own = {(slot_of[w][s], t, n) for s, t, n in blocks}
            texts.update((s, t) for s, t, _ in own)
            seen.update({s for s, _, _ in own})
            for s, t, n in own:
                old = stats.get(s, (0, 0))
                stats[s] = (old[0] + len(t), old[1] + n)
        template = {(s, t) for (s, t), n in texts.items() if n >= html_wrappers.LEAST_PAGES and 2 * n > seen[s]}
        away = collections.Counter()
        for w, blocks in distinct:
            for s, t, _ in {(slot_of[w][s], t, n) for s, t, n in blocks}:
                away[s] += len(t) * ((s, t) in template)
        keep = html_wrappers.decide(wrapper, {s: (*x, away[s]) for s, x in stats.items()}, len(distinct))
        for page_id, w, blocks in rows:
            kept = [(slot_of[w][s], t) for s, t, _ in blocks if keep[slot_of[w][s]]]
            own = [b for b in kept if b not in template]
            if 2 * sum(len(t) for _, t in own) < sum(len(t) for _, t in kept):
                own = kept
            out[page_id] = "\n".join(t for _, t in own)
    return out


NOTICE = "Dear reader, all prices on this site are in dollars and change without warning."


def site(rng, host, count, first):
    """Pages without telling names: a menu, a side column, and the article with a notice inside."""
    rows, want = [], {}
    for i in range(count):
        title, parts = words(rng, 5), [words(rng, rng.randint(30, 60)) for _ in range(rng.randint(2, 5))]
        quote = words(rng, 8)  # an element of its own for each page, so that hardly two pages have one expression
        menu = "".join(f"<div><a href='/{k}'>{words(rng, 2)}</a></div>" for k in range(6))
        side = f"<div class='q'><div>{words(rng, 6)}</div><div>{words(rng, 5)}</div></div>" if i % 2 else ""
        body = f"<h1>{title}</h1>" + "".join(f"<p>{p}</p>" for p in parts[:1]) + f"<div class='z'><div>{NOTICE}</div></div>" + "".join(f"<p>{p}</p>" for p in parts[1:]) + f"<blockquote class='{words(rng, 1)}'>{quote}</blockquote>"
        rows.append((first + i, f"http://{host}/{i}", f"<html><body><div class='k'>{menu}</div>{side}<div class='w'><div class='v'>{body}</div></div><div class='e'>{words(rng, 9)}</div></body></html>"))
        want[first + i] = "\n".join([title, *parts, quote])
    return rows, want


def test_alignment_decides(spark, monkeypatch):
    rng = random.Random(5)
    one, want_one = site(rng, "one.example", 30, 0)
    two, want_two = site(rng, "two.example", 12, 100)
    rows = [*one, *two, (900, None, None), (901, "http://one.example/x", ""), (902, "http://solo.example/x", "<article><h2>a</h2><p>b c</p></article><p>d</p>")]
    rows += [(903, one[3][1], one[3][2])] * 3  # copies say nothing about the template
    want = {**want_one, **want_two, 900: "", 901: "", 902: "a\nb c", 903: want_one[3]}
    assert brute(rows) == want
    df = spark.createDataFrame(rows, PAGES)
    for part in (256, 2):  # in one part, and in several that are aligned again
        monkeypatch.setattr(html_wrappers, "PART", part)
        got = {r.page_id: (r.text, r.n_chars) for r in html_wrappers.main_text(df).collect()}
        assert got == {i: (t, len(t)) for i, t in want.items()}
    apart = brute([r for r in rows if r[0] < 900], aligned=False)
    assert sum(NOTICE in t for t in apart.values()) > 5  # without alignment a slot's texts are not seen on most pages


def test_spark_equals_brute_force(spark):
    rng, rows = random.Random(7), []
    tags = ["p", "div", "h2", "section", "ul", "article", "nav", "table", "div class='ad x'", "div class=body"]
    for i in range(120):
        parts = []
        for _ in range(rng.randint(0, 12)):
            tag = rng.choice(tags)
            text = rng.choice([words(rng, rng.randint(1, 30)), "same text", f"<a href=x>{words(rng, 3)}</a>", f"<b>{words(rng, 2)}</b><p>{words(rng, 9)}"])
            parts.append(rng.choice([f"<{tag}>{text}</{tag.split()[0]}>", f"<{tag}>{text}", text]))
        rows.append((i, f"http://h{i % 4}.example/{i}", "".join(parts)))
    want = brute(rows)
    got = {r.page_id: r.text for r in html_wrappers.main_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == want


def test_all_words_of_an_element_are_judged():
    many = "flex flex-col gap-4 mt-8 px-4 bg-white rounded-lg shadow border w-full sidebar"
    assert brute([(1, None, f"<div class='{many}'>menu text</div><p>main text</p>")])[1] == "main text"
    deep = "<div>" * 3000 + "<nav>" * 70 + "links" + "</nav>" * 70 + "<p>main text</p>"
    assert brute([(1, None, deep)])[1] == "main text"
    assert brute([(1, None, "<div hidden>x</div><div class='Comments'>y</div><p>z")])[1] == "z"


def test_pages_of_thousands_of_siblings():
    rng = random.Random(2)
    pages = [[f"<div class='{words(rng, 1)}{rng.choice('xyz')}'>{words(rng, 3)}</div>" for _ in range(4000)] for _ in range(2)]
    began = time.perf_counter()
    texts = [html_wrappers.expression("<article>" + "".join(p))[0] for p in pages]
    wrapper, slots = html_wrappers.merged(texts)
    assert all(len(s) > 1000 for s in slots) and wrapper
    assert time.perf_counter() - began < 20
