import json

from lexmill.operators import translation
from lexmill.schemas import Settings
from lexmill.sources import renames


def _tree(root, *names):
    for name in names:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(name)


def names(root):
    return {str(p.relative_to(root)): p.read_text() for p in root.rglob("*") if p.is_file() and not p.name.endswith(".crc")}


def test_a_tree_with_clashes(spark, tmp_path):
    root = tmp_path / "tree"
    _tree(root, "a/one.v2.pdf", "a/one v2.pdf", "a/x.y.z", "a/x_y.z", "a/x,y.z.q", "a/x y.z.q", "b/x.y.z", "b/x_y_z", "b/c/d.e.pdf", "plain.pdf", "a.b.txt")
    got = {(r.name, r.target): r.renamed for r in renames.rename_files(spark, str(root), f"{tmp_path}/log").collect()}
    assert got == {("one.v2.pdf", "one_v2.pdf"): True, ("x.y.z", "x_y_z"): True, ("x y.z.q", "x_y_z_q"): True, ("d.e.pdf", "d_e.pdf"): True, ("a.b.txt", "a_b_txt"): True}
    assert names(root) == {"a/one_v2.pdf": "a/one.v2.pdf", "a/one v2.pdf": "a/one v2.pdf", "a/x_y_z": "a/x.y.z", "a/x_y.z": "a/x_y.z", "a/x_y_z_q": "a/x y.z.q", "a/x,y.z.q": "a/x,y.z.q",
                           "b/x.y.z": "b/x.y.z", "b/x_y_z": "b/x_y_z", "b/c/d_e.pdf": "b/c/d.e.pdf", "plain.pdf": "plain.pdf", "a_b_txt": "a.b.txt"}


def test_an_interrupted_run_is_taken_up(spark, tmp_path):
    root, log = tmp_path / "tree", f"{tmp_path}/log"
    _tree(root, "a.b.c", "d.e.f", "g.h.i")
    renames.targets(renames.listed(spark, str(root))).write.parquet(log)  # the plan of a run that got as far as one file
    (root / "a.b.c").rename(root / "a_b_c")
    (root / "g_h_i").write_text("came since")
    got = {r.name: r.renamed for r in renames.rename_files(spark, str(root), log).collect()}
    assert got == {"a.b.c": True, "d.e.f": True, "g.h.i": False}
    assert names(root) == {"a_b_c": "a.b.c", "d_e_f": "d.e.f", "g.h.i": "g.h.i", "g_h_i": "came since"}


def test_bodies(spark):
    words = spark.createDataFrame([("one", 5), ("two", 9), ('q"', 1), ("раз", 2), ("три", 3)], "word string, cnt long")
    asked = translation.requests(words, Settings(translate_batch=2), folderId="f")
    bodies = {(r.src_lang, r.batch): json.loads(r.body) for r in asked.collect()}
    assert bodies == {("en", 0): {"folderId": "f", "texts": ["two", "one"], "targetLanguageCode": "ru"}, ("en", 1): {"folderId": "f", "texts": ['q"'], "targetLanguageCode": "ru"},
                      ("ru", 0): {"folderId": "f", "texts": ["три", "раз"], "targetLanguageCode": "en"}}
    answers = [("en", 0, '{"translations": [{"text": "два", "detectedLanguageCode": "en"}, {"text": null}]}'), ("en", 1, "not json"), ("ru", 0, '{"translations": [{"text": "three"}]}')]
    got = translation.answered(asked, spark.createDataFrame(answers, "src_lang string, batch long, body string"))
    assert {tuple(r) for r in got.collect()} == {("two", "два"), ("one", "—"), ('q"', "—"), ("три", "—"), ("раз", "—")}
    none = translation.answered(asked, spark.createDataFrame([], "src_lang string, batch long, body string"))
    assert {r.translation for r in none.collect()} == {"—"} and none.count() == 5
