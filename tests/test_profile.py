import json

from lodestone.plans.profile import LARGEST_PROFILE, Profile, write_profile


def test_report(spark, tmp_path):
    profile = Profile(spark)
    for _ in range(2):
        with profile.phase("scan"):
            pass
    files = spark.createDataFrame([(".txt", "indexed", k, float(k)) for k in range(1, 41)], "extension string, status string, size_bytes long, ms double")
    report = profile.report(files)
    assert report["formats"] == {".txt": {"n": 40, "p50": 20, "p95": 38, "max": 40.0}}
    assert [s["ms"] for s in report["slowest"]] == [float(k) for k in range(40, 20, -1)] and set(report["phases"]) == {"scan"}
    path = str(tmp_path / "p.json")
    assert write_profile(path, report) == json.load(open(path))
    assert write_profile(path, report | {"slowest": ["x" * LARGEST_PROFILE]})["omitted"] == ["slowest"]
