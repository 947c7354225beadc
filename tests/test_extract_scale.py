from weftgraph.operators import extract
from weftgraph.plans import catalog
from weftgraph.sources.python_facts import FileFacts


def part(spark, tmp_path, n=3):
    spark.createDataFrame([(i,) for i in range(n)], "p_partkey int").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


def test_descriptions_seek_no_relations(spark, tmp_path, monkeypatch):
    def relations(facts):
        raise AssertionError("relations were sought")

    monkeypatch.setattr(extract, "relations", relations)
    assert catalog.queries()["extract_descriptions"](spark, part(spark, tmp_path)).count() == 6


def test_one_question_for_a_name_in_many_files(spark, tmp_path, monkeypatch):
    """Names that other files answer are resolved once, not once a file."""
    asked, real = [], extract.resolved

    def counted(wanted, *rest, **named):
        asked.append(wanted.count())
        return real(wanted, *rest, **named)

    monkeypatch.setattr(extract, "resolved", counted)
    got = [catalog.queries()["extract_calls"](spark, part(spark, tmp_path / str(n), n)).count() for n in (2, 8)]
    assert got == [12, 48] and asked[0] == asked[1]


def test_names_settled_in_their_file():
    text = "X = 1\n\n\ndef f(a: 'K[int]'):\n    global X\n    X = 2\n    return g(é) or K.m()\n\n\ndef f():\n    pass\n\n\nclass K:\n    def m(self):\n        return f()\n"
    rows = FileFacts("p.py", text).run()
    named = {(r["fact"], r.get("scope"), r.get("chain") or r.get("name")): (r.get("s_name"), r.get("t_name"), r.get("t_seq")) for r in rows if r["fact"] not in ("file", "entity")}
    first = next(r["seq"] for r in rows if r["fact"] == "entity" and r["name"] == "f")
    assert named["call", "K.m", "f"] == ("m", "f", first)
    assert named["param", "f", "K[int]"][1] == "K" and named["call", "f", "K.m"][1] == "m"
    assert named["global", "f", "X"][:2] == ("f", "X") and named["call", "f", "g"][1] is None
