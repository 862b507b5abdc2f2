import math
import re
from collections import Counter

import pytest

from threadloom.llm import licenses

FILES = "doc_id long, path string, text string, license string, _line int, _norm double"


@pytest.fixture
def files(spark):
    return lambda rows: spark.createDataFrame([(*r, "x", 1, 2.0) for r in rows], FILES)


def own_license(text, texts):
    """Weigh every line against every template."""
    said = lambda s: re.findall("[a-z0-9]+", s.lower())
    vocabulary = {t for v in licenses.TEMPLATES.values() for t in said(v)}
    df = Counter(t for x in texts for t in set(said(x or "")) & vocabulary)
    weigh = lambda c: {t: n * (math.log((1 + len(texts)) / (1 + df[t])) + 1) for t, n in c.items()}
    best = []
    for line in (text or "").split("\n"):
        a = weigh(Counter(said(line)))
        for name, template in licenses.TEMPLATES.items():
            b = weigh(Counter(said(template)))
            norm = math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
            score = round(sum(a[t] * b[t] for t in a if t in b) / norm, 6) if norm else 0
            if score >= licenses.THRESHOLD:
                best.append((-score, name))
    return min(best)[1] if best else None


def test_lines_and_inheritance(files):
    mit, apache, gpl = "Released under the MIT License.", "# licensed under the apache license version 2.0", "This work is licensed under the GNU General Public License, version 3."
    rows = [(1, "a/LICENSE", "title\n" + mit), (2, "a/b/c/x.py", "code"), (3, "a/b/LICENCE.txt", apache), (4, "a/b/y.py", None), (5, "a/z.py", gpl + "\nmore"), (6, "q/x", "the of under this license"),
            (7, None, mit), (8, None, "none"), (9, "LICENSE.md", "Licensed under CC BY-NC 4.0."), (10, "q/r/s", ""), (11, "/abs/f", "x"), (12, "a/b/c/LICENSE", "no license at all"),
            (13, "ab/f", "word " * 5000 + "\n" + mit), (4, "a/b/y.py", None), (14, "a/COPYING", gpl + " x"), (15, "a/b2/f", "x")]
    got = {(r.doc_id, r.path): (r.license, r.how, r.from_path) for r in licenses.scan(files(rows)).collect()}
    texts = [r[2] for r in rows]
    for doc, path, text in rows:
        mine = own_license(text, texts)
        if mine:
            assert got[doc, path] == (mine, "own", path)
    assert got[2, "a/b/c/x.py"] == got[12, "a/b/c/LICENSE"] == got[4, "a/b/y.py"] == ("Apache-2.0", "inherited", "a/b/LICENCE.txt")
    assert got[15, "a/b2/f"] == ("MIT", "inherited", "a/LICENSE")
    assert got[6, "q/x"] == got[10, "q/r/s"] == got[11, "/abs/f"] == ("CC-BY-NC-4.0", "inherited", "LICENSE.md")
    assert got[8, None] == (None, "none", None)
    assert licenses.scan(files(rows)).count() == len(rows)


def test_empty_table(files):
    assert licenses.scan(files([])).count() == 0


def test_needed_terms_bound_the_cosine():
    weights = {"a": 5.0, "b": 3.0, "c": 1.0, "d": 0.5}
    needed = licenses.needed_terms(weights, 0.75)
    norm = math.sqrt(sum(w * w for w in weights.values()))
    assert "a" in needed and math.sqrt(sum(w * w for t, w in weights.items() if t not in needed)) < 0.75 * norm


def test_license_texts_and_wrapped_headers(files):
    """Whole license files and headers over several comment lines, none of them in the test tables."""
    import textwrap

    texts = licenses.whole_texts()
    gnu = "This file is part of X.\n\nX is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version.\n\nX is distributed in the hope that it will be useful."

    def header(mark, text):
        return "\n".join(f"{mark} {x}".rstrip() for part in text.split("\n") for x in (textwrap.wrap(part, 60) or [""])) + "\nint main() { return 0; }\n"

    rows = [(i, f"d{i}/LICENSE", "Copyright (c) 2020 Some Body\n\n" + "\n".join(textwrap.wrap(text, 70))) for i, text in enumerate(texts.values())]
    want = {f"d{i}/LICENSE": name for i, name in enumerate(texts)}
    for path, name, text in (("h/1.c", "GPL-3.0", header(" *", gnu.format("General Public License", 3))), ("h/2.py", "GPL-2.0", header("#", gnu.format("General Public License", 2))),
                             ("h/3.py", "LGPL-2.1", header("#", gnu.format("Lesser General Public License", "2.1"))), ("h/4.py", "AGPL-3.0", header("//", gnu.format("Affero General Public License", 3))),
                             ("h/5.py", "BSD-2-Clause", header("#", texts["BSD-2-Clause"])), ("h/6.py", "BSD-3-Clause", header("//", texts["BSD-3-Clause"])),
                             ("h/7.go", "Apache-2.0", header("//", licenses.HEADERS["Apache-2.0"] + "\n\n    http://www.apache.org/licenses/LICENSE-2.0"))):
        rows.append((len(rows), path, text))
        want[path] = name
    rows += [(len(rows) + i, f"d{i}/sub/x.py", "code") for i in range(len(texts))]
    got = {r.path: r for r in licenses.scan(files(rows)).collect()}
    assert {p: got[p].license for p in want} == want
    assert {got[f"d{i}/sub/x.py"].license: got[f"d{i}/sub/x.py"].how for i in range(len(texts))} == {name: "inherited" for name in texts}


def block_scores(path, text):
    """Every paragraph, comment run and whole license file against every template, by the formula."""
    said = lambda x: re.findall("[a-z0-9]+", x.lower())
    lower = "".join(c.lower() if c.isascii() else c for c in text or "")
    paragraphs = re.split(r"\n[ \t\r]*\n", re.sub(licenses.COMMENT.replace("(?m)", ""), "", lower, flags=re.M))
    mark, runs = re.compile(r"[ \t]*(?://|/\*|\*|#|--|;|%|<!--)"), [[]]
    for line in lower.split("\n"):
        if line.strip(" \t\r") and not mark.match(line):
            runs.append([])
        else:
            runs[-1].append(line)
    speaks = re.search(r"([^/.]*)[^/]*\Z", path or "")[1].lower() in licenses.LICENSE_FILES
    found = set()
    for kind, segments in ((licenses.HEADERS, paragraphs), (licenses.whole_texts(), ["\n".join(r) for r in runs] + ([lower] if speaks else []))):
        counts = {n: Counter(said(t)) for n, t in kind.items()}
        df = Counter(t for c in counts.values() for t in c)
        weigh = lambda c: {t: (1 + math.log(n)) * (math.log((1 + len(kind)) / (1 + df[t])) + 1) for t, n in c.items()}
        for segment in segments:
            a = weigh(Counter(said(segment)))
            for name, c in counts.items():
                b = weigh(c)
                norm = math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
                score = round(sum(x * b[t] for t, x in a.items() if t in b) / norm, 6) if norm else 0
                if score >= licenses.THRESHOLD:
                    found.add((name, score))
    return found


def test_blocks_against_brute_force(files):
    """Headers and license texts, whole, cut, mixed with prose and with each other."""
    import random

    rng, whole = random.Random(8), licenses.whole_texts()
    prose = lambda n: " ".join(rng.choice("the of and to in a is that for it on with as this by from or".split()) if rng.random() < 0.4 else f"w{rng.randrange(900)}" for _ in range(n))
    rows = [(1, "x.py", None), (2, "LICENSE", ""), (3, "a.py", prose(400)), (4, None, prose(50))]
    for name, text in [*licenses.HEADERS.items(), *((n, t) for n, t in whole.items() if len(t) < 12_000)]:
        words = text.split()
        part = lambda share: " ".join(words[:max(1, int(len(words) * share))])
        for i, body in enumerate((text, part(0.6), part(0.8) + " " + prose(len(words) // 3), prose(40) + "\n\n" + text + "\n \n" + prose(30), "# " + "\n#".join(text.split("\n")) + "\nint x;\n" + prose(20))):
            rows.append((len(rows) + 1, rng.choice(["LICENSE", "src/a.c", "COPYING.txt", "b.md", None]), body))
    got = {}
    for r in licenses.scan_blocks(files(rows)).collect():
        got.setdefault(r.doc_id, set()).add((r.license, r.score))
    want = {doc: scores for doc, path, text in rows if (scores := block_scores(path, text))}
    assert {d: {n for n, _ in s} for d, s in got.items()} == {d: {n for n, _ in s} for d, s in want.items()}
    for doc, scores in want.items():
        assert sorted(s for _, s in got[doc]) == pytest.approx(sorted(s for _, s in scores), abs=2e-6)


def test_telling_terms_bound_the_cosine():
    weights, idf, _ = licenses._damped(licenses.whole_texts())
    for name, w in weights.items():
        part, n = licenses.telling_terms(w, idf, 0.75)
        heaviest = sorted((w[t] for t in part), reverse=True)[:n - 1]
        rest = sum(x * x for t, x in w.items() if t not in set(part))
        assert n >= 1 and rest + sum(x * x for x in heaviest) < 0.75 ** 2 + 1e-6, name
