"""Registry CSVs against the csv module, whole and in small blocks."""

import csv
import io

from nearwell.sources.readers import csv_records, scan_registry_csv

FILES = {
    "a.csv": 'source,registry_name,city,accredited\r\nX,"One, ""1""\nof two",Gaya,true\r\n\r\nX,Two,,\r\n',
    "b.csv": 'city,extra,registry_name,city\nPatna,e,"' + "long\n\n" * 60 + 'name",Gaya\nq,r\n"",x,"y"\n',
    "c.csv": "source,registry_name\n" + "".join(f'S{i},"n{i}\n{i}"\n' for i in range(300)),
    "d.csv": "",
}


def plain(names):
    out = []
    for f in sorted(FILES):
        for r in csv.DictReader(io.StringIO(FILES[f].replace("\r\n", "\n"), newline="")):
            out.append((f, *[r.get(n) or None for n in names]))
    return out


def test_registry_files_match_the_csv_module(spark, tmp_path):
    for f, text in FILES.items():
        (tmp_path / f).write_text(text, newline="")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for size in ("128m", "97"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            rows = scan_registry_csv(spark, f"{tmp_path}/*.csv", positions=True)
            names = [c for c in rows.columns if c not in ("file", "pos")]
            got = [(r["file"].rsplit("/", 1)[1], *[r[n] or None for n in names])
                   for r in rows.orderBy("file", "pos").collect()]
            assert got == plain(names)
            splits = csv_records(spark, f"{tmp_path}/c.csv").count()
            assert splits == 301
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "x.csv").write_text("")
    assert scan_registry_csv(spark, f"{tmp_path}/none/*.csv").count() == 0
