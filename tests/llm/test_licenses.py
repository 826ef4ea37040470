import math
import re
from collections import Counter

import duckdb

from quartzfolio.llm import licenses as lc
from quartzfolio.llm import queries


def blocks(text):
    """Comment lines in a row."""
    out, open_ = [], False
    for line in text.split("\n"):
        is_comment = line.lstrip(" \t").startswith(("#", "//", "*", "/*", "--", ";"))
        if is_comment and open_:
            out[-1] += "\n" + line
        elif is_comment:
            out.append(line)
        open_ = is_comment
    return out


def brute(files):
    """{key: (license, score, origin, license_path)} straight from the definition."""
    cue = re.compile(lc.CUES)
    is_file = lambda p: bool(p and re.search(lc.LICENCE_FILE, p))
    units = {}
    for key, path, text in files:
        us = [x for x in [*(text or "").split("\n"), *blocks(text or "")] if cue.search(x)]
        units[key] = dict.fromkeys(us + ([text] if is_file(path) and text else []))
    bag = lambda t: Counter(x for x in re.split(lc.SEPARATORS, t.lower()) if x)
    known = [(name, bag(t)) for name, ts in lc.TEMPLATES.items() for t in ts]
    all_bags = [bag(t) for us in units.values() for t in us] + [b for _, b in known]
    df = Counter(t for b in all_bags for t in b)
    weigh = lambda b: {t: n * (math.log((len(all_bags) + 1) / (df[t] + 1)) + 1) for t, n in b.items()}
    norm = lambda w: math.sqrt(sum(x * x for x in w.values()))

    def best(text):
        w = weigh(bag(text))
        said = []
        for name, b in known:
            v = weigh(b)
            dot = sum(w[t] * v[t] for t in w if t in v)
            if dot:
                said.append((-round(dot / norm(w) / norm(v), 6), name))
        return min(said, default=None)

    own = {}
    for key, us in units.items():
        hits = [b for b in map(best, us) if b and -b[0] >= lc.THRESHOLD]
        if hits:
            own[key] = min(hits)
    heads = {}
    for key, path, _ in files:
        if key in own and is_file(path):
            d = path.rpartition("/")[0]
            heads[d] = min(heads.get(d, (path, own[key][1], -own[key][0])), (path, own[key][1], -own[key][0]))
    out = {}
    for key, path, _ in files:
        if key in own:
            out[key] = (own[key][1], -own[key][0], "own", path)
            continue
        d = None if path is None else path.rpartition("/")[0]
        while d is not None and d not in heads:
            d = d.rpartition("/")[0] if d else None
        out[key] = (heads[d][1], heads[d][2], "inherited", heads[d][0]) if d is not None else (None, None, "none", None)
    return out


def test_against_brute_force(spark):
    files = [
        ("1", "a/b/c.txt", "code\nReleased under the MIT License.\nmore"), ("2", "a/LICENSE", "Apache text\nLicensed under the Apache License, Version 2.0."), ("3", "a/b/d.txt", "no notice"),
        ("4", "a/b/e/f/g.txt", None), ("5", "z/q.txt", ""), ("6", "COPYING", "This work is licensed under the GNU General Public License, version 3."), ("7", "a/b/e/LICENCE.md", "some licence we do not know of at all, with warranty"),
        ("8", None, "copyright holders"), ("9", None, "Licensed under CC BY-NC 4.0."), ("10", "a/LICENSE.2", "Released under the ISC License."), ("11", "x", "w " * 50_000 + "\nSPDX-License-Identifier: MIT\n" + "w " * 50_000), ("12", "/abs/dir/f", "nothing"),
        ("13", "a/src/h.py", "# " + "\n# ".join(lc.APACHE_HEADER.replace("; you", ";\nyou").split("\n")) + "\nimport os\n"), ("14", "b/LICENSE", "Copyright (c) 2020\n\n" + lc.ISC_TEXT), ("15", "b/x/y", "plain"),
        ("16", "c/LICENSE", lc.TWO_CLAUSES + lc.DISCLAIMER), ("17", "d/LICENSE", lc.TWO_CLAUSES + lc.THIRD_CLAUSE + lc.DISCLAIMER), ("18", "e/COPYING", lc.PERMISSION), ("19", "e/f", "; warranty\n;\n" * 30_000),
    ]
    df = spark.createDataFrame([(*f, 1.0) for f in files], "key string, path string, text string, score double")
    got = {r["key"]: tuple(r)[2:] for r in lc.scan(df).collect()}
    assert got == brute(files)
    assert {k: got[k][0] for k in ("13", "14", "15", "16", "17", "18", "19")} == {"13": "Apache-2.0", "14": "ISC", "15": "ISC", "16": "BSD-2-Clause", "17": "BSD-3-Clause", "18": "MIT", "19": "MIT"}


def test_documents_against_brute_force_and_sql(spark, sf_dir):
    got = queries.op8_licenses(spark, sf_dir)
    docs = queries.virtual_files(queries.table(spark, sf_dir, "documents"))
    want = brute([(r["key"], r["path"], r["text"]) for r in docs.collect()])
    rows = got.collect()
    assert {r["path"]: tuple(r[c] for c in ("license", "score", "origin", "license_path")) for r in rows} == {r["path"]: want[r["key"]] for r in docs.collect()}
    assert any(r["origin"] == "own" for r in rows)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    sql = con.sql(queries.ORACLE_SQL["op8_licenses"])
    assert sorted(map(tuple, got.select(sql.columns).collect()), key=str) == sorted(sql.fetchall(), key=str)


def test_odd_inputs(spark):
    schema = "key string, path string, text string"
    assert lc.scan(spark.createDataFrame([], schema)).count() == 0
    rows = [("1", "d/f", "Released under the MIT License.")] * 3
    assert [r["license"] for r in lc.scan(spark.createDataFrame(rows, schema)).collect()] == ["MIT"] * 3
    clash = spark.createDataFrame([("1", "d/f", "Released under the MIT License.", 1, "x"), ("1", "d/f", "Released under the ISC License.", 2, "y"), (None, None, None, 3, "z")], schema + ", row int, dir string")
    assert sorted((r["key"], r["license"]) for r in lc.scan(clash).where("key IS NOT NULL").collect()) == [("1", "ISC"), ("1", "MIT")]
    assert lc.scan(clash).count() == 3


def test_a_directory_with_most_files(spark):
    rows = [("L", "a/LICENSE", "Released under the MIT License.")] + [(str(i), f"a/b/{i}", None) for i in range(300)] + [(f"c{i}", f"c/{i}", None) for i in range(300)]
    got = lc.scan(spark.createDataFrame(rows, "key string, path string, text string")).groupBy("origin").count().collect()
    assert {r["origin"]: r["count"] for r in got} == {"own": 1, "inherited": 300, "none": 300}


def test_no_python_on_the_main_path(spark, sf_dir):
    plan = queries.op8_licenses(spark, sf_dir)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|ExistingRDD", plan)
