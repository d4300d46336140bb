import random

import pytest

from lamina.plans import run


def corpus(tmp_path):
    rng = random.Random(1)
    pools = [["apple", "pears", "plums", "fruit"], ["wheel", "engines", "brakes", "car"]]
    sentence = lambda k: " ".join(rng.choice(pools[k]) for _ in range(6)) + " the."
    for s in ("one", "two"):
        for d in range(3):
            cut = rng.randint(3, 6)
            (tmp_path / f"{s}.{d}").write_text("\n".join([sentence(0) for _ in range(cut)] + [sentence(1) for _ in range(9 - cut)]) + "\n")
            with (tmp_path / f"{s}.part").open("a") as f:
                f.write(f"{d} {cut}\n")
        cuts = [tuple(map(int, x.split())) for x in (tmp_path / f"{s}.part").read_text().splitlines()]
        (tmp_path / f"{s}.part").unlink()
        (tmp_path / f"{s}.label").write_text("0 " + " ".join(f"{d}::0-{c - 1}" for d, c in cuts) + "\n1 " + " ".join(f"{d}::{c}-8" for d, c in cuts) + "\n")
    (tmp_path / "stop.list").write_text("first\nthe\n.\n")
    return tmp_path


BASE = {"corpus.useTokenizer": "true", "corpus.useStemmer": "true", "corpus.removeStopword": "true", "prior.docset.globalType": "5", "prior.docset.localType": "1"}


@pytest.mark.parametrize(
    ("model", "more"),
    [
        ("x.y.SingleModel", {"exp.trial": "2"}), ("kmeans", {"exp.perDocEval": "true"}),
        ("multi", {"sampler.maxMcmcIter": "300", "sampler.initGlobal": "300", "prior.doc.0.localType": "0", "sampler.docset.maxGlobalCluster.one": "2", "sampler.initUniform": "true", "model.sharedDict": "true"}),
    ],
)
def test_experiment(spark, tmp_path, model, more):
    folder = tmp_path / "in"
    folder.mkdir()
    corpus(folder)
    config = BASE | {"model.class": model, "corpus.datasetDir": str(folder), "corpus.stopwordList": str(folder / "stop.list"), "output.outputDir": str(tmp_path / "out"), "exp.output": str(tmp_path / "report")} | more
    config |= {"exp.log": str(tmp_path / "log"), "exp.console": "false", "sampler.printPeriod": "100"}
    rows = run.run(spark, config).collect()
    assert len(rows) == {"SingleModel": 4, "kmeans": 6, "multi": 2}[model.rsplit(".")[-1]]
    scores = [dict(p.split("=") for p in r["line"].split("\t")) for r in rows]
    assert all(float(s["F1"]) > 0.8 and float(s["Pk"]) < 0.3 for s in scores), rows
    assert list((tmp_path / "out/trial-1/segments").glob("docset=one/doc_id=0/*.txt")) and list((tmp_path / "report").glob("part*"))


    logged = (tmp_path / "log").read_text().splitlines()
    assert len(logged) == {"SingleModel": 2, "kmeans": 1, "multi": 4}[model.rsplit(".")[-1]]
    if model == "multi":
        for i, line in enumerate(logged[:3]):
            found = dict(p.split("=") for p in line.split("trial 1: ")[1].split())
            assert list(found) == ["iter", "loglik", "global", "local", "shift", "P", "R", "F1", "Pk", "WD", "seconds"] and int(found["iter"]) == 100 * (i + 1) and float(found["loglik"]) < 0
        assert 0.8 < float(found["F1"]) <= 1 and float(found["Pk"]) < 0.3


def test_model_names():
    assert [run.model_of(n) for n in ("multi", "a.b.KMeanThing", "Single")] == ["multi", "kmeans", "single"]
    with pytest.raises(ValueError):
        run.model_of("other")


def test_no_folder(spark):
    assert run.run(spark, {}) is None
