import re

from pyspark.sql import functions as F

from tessera.llm import licenses


def fold(text):
    return re.sub(r"[^\w]+|_", " ", text.lower()).split()


def brute(text, least=0.8):
    """Licences by exact containment in any stretch as long as the template."""
    grams = lambda w: {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
    w, out = fold(text or ""), {}
    for n, (name, template) in enumerate(licenses.TEMPLATES):
        t = grams(fold(template))
        k = len(fold(template))
        best = max((len(t & grams(w[i : i + k])) / len(t) for i in range(max(1, len(w) - k + 1))), default=0)
        if best >= least:
            out[n] = name
    return out


def test_finds_what_brute_force_finds(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = {(r["doc_id"], r["license"]) for r in licenses.scan(docs).collect()}
    near = {(r["doc_id"], x) for r in docs.collect() for x in brute(r["text"], 0.8).values()}
    whole = {(r["doc_id"], x) for r in docs.collect() for x in brute(r["text"], 1.0).values()}
    assert whole <= got <= near


def test_templates_and_variants(spark):
    filler = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod "
    rows = [(i, filler * 3 + t + " " + filler * 2, name) for i, (name, t) in enumerate(licenses.TEMPLATES)]
    got = {}
    for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, license string")).collect():
        got.setdefault(r["doc_id"], set()).add(r["license"])
    assert all(name in got[i] for i, _, name in rows)
    mit = licenses.TEMPLATES[3][1].replace("sublicense", "relicense")
    assert "MIT" in {r["license"] for r in licenses.scan(spark.createDataFrame([(1, filler + mit)], "doc_id long, text string")).collect()}


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "the MIT"), (4, "license " * 1000), (5, "Released under the MIT License."), (5, "Released under the MIT License."), (None, "x " * 40_000 + licenses.TEMPLATES[7][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.lit(1)).withColumn("at", F.lit(2))
    got = sorted(((r["doc_id"] or 0, r["license"], r["containment"]) for r in licenses.scan(docs).collect()))
    assert got == [(0, "GPL-3.0", 1.0), (5, "MIT", 1.0)]
    assert licenses.scan(docs.limit(0)).count() == 0


def test_plan_has_no_python(spark, data):
    plan = licenses.scan(spark.read.parquet(f"{data}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def names(spark, *texts):
    got = {}
    for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        got.setdefault(r["doc_id"], set()).add(r["license"])
    return [got.get(i, set()) for i in range(len(texts))]


def test_declarations_in_documents(spark, data):
    line = re.compile(r"(?<!\w)all\W+rights\W+reserved(?!\w)", re.I)
    docs = spark.read.parquet(data.replace("sf0.001", "sf0.01") + "/documents.parquet")
    want = {r["doc_id"] for r in docs.collect() if line.search((r["text"] or "").replace("_", " "))}
    assert want and {r["doc_id"] for r in licenses.scan(docs).where("license = 'proprietary'").collect()} == want


def test_short_templates_at_every_position(spark):
    filler = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor".split()
    texts = [" ".join([*filler[:i], t, *filler[:j]]) for t in ("All rights reserved.", "Released under the MIT License.") for i in range(7) for j in (0, 1, 5)]
    assert names(spark, *texts) == [{"proprietary"}] * 21 + [{"MIT"}] * 21


def test_whole_texts_have_their_own_names(spark):
    opening = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n"
    two = "1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n   and/or other materials provided with the distribution.\n\n"
    third = "3. Neither the name of {} nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.\n\n"
    end = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\"\nAND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE\nIMPLIED WARRANTIES OF MERCHANTABILITY ARE DISCLAIMED."
    gpl = "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Preamble The GNU General Public License is a free, copyleft license for\nsoftware and other kinds of works.\n"
    agpl = "Preamble The GNU Affero General Public License is a free, copyleft license for\nsoftware and other kinds of works, specifically designed to ensure\ncooperation with the community in the case of network server software.\n"
    got = names(spark, opening + two + end, opening + two + third.format("the copyright holder") + end, opening + two + third.format("Example University") + end, gpl, agpl)
    assert got == [{"BSD-2-Clause"}, {"BSD-3-Clause"}, {"BSD-3-Clause"}, {"GPL-3.0"}, {"AGPL-3.0"}]
