"""One scan a header, and what does not fit goes to the quarantine."""

import gzip
import os
import tempfile

from agrolattice.sources.tables import catalog_quarantine, read_catalog_files, scan_catalog


def folder(files):
    d = tempfile.mkdtemp(prefix="agrolattice-test-")
    for name, data in files.items():
        with open(os.path.join(d, name), "wb") as f:
            f.write(data if isinstance(data, bytes) else data.encode())
    return [os.path.join(d, name) for name in sorted(files)]


def test_files_of_one_header_are_one_scan(spark):
    headers = ["UID,Titulo", "\ufeffUID,Titulo", "Titulo,UID", 'UID,"Titulo, largo"']
    paths = folder({f"reto_{i:03}.csv": f"{headers[i % 4]}\nu{i},t{i}\n" for i in range(120)})
    scans, skipped = scan_catalog(spark, paths)
    assert len(scans) == 3 and not skipped
    got = {(r["UID"], r["Titulo"], r["Titulo, largo"]) for r in read_catalog_files(spark, paths).collect()}
    want = {0: ("u{}", "t{}", None), 1: ("u{}", "t{}", None), 2: ("t{}", "u{}", None), 3: ("u{}", None, "t{}")}
    assert got == {tuple(x and x.format(i) for x in want[i % 4]) for i in range(120)}


def test_broken_files_and_rows_do_not_end_the_job(spark):
    paths = folder({"a.csv": "UID,Titulo\nu1,one\nu2\nu3,three,more\n", "b.csv": "", "c.csv.gz": b"not gzip at all",
                    "d.csv.gz": gzip.compress(b"UID,Titulo\nu4,four\n"), "e.csv": '"UID","Ti\ntulo"\nu5,"fi\nve"\n'})
    paths.append(os.path.join(os.path.dirname(paths[0]), "absent.csv"))
    df = read_catalog_files(spark, paths)
    assert sorted(r["UID"] for r in df.collect()) == ["u1", "u2", "u3", "u4", "u5"]
    assert [r["Ti\ntulo"] for r in df.where("UID = 'u5'").collect()] == ["fi\nve"]
    bad = {(os.path.basename(r["file"]), r["problem"].split(":")[0], r["record"]) for r in catalog_quarantine(spark, paths).collect()}
    assert bad == {("a.csv", "row does not fit the header", "u2"), ("a.csv", "row does not fit the header", "u3,three,more"),
                   ("b.csv", "no header", None), ("c.csv.gz", "unreadable", None), ("absent.csv", "unreadable", None)}


def test_no_files(spark):
    assert read_catalog_files(spark, []).count() == 0 and catalog_quarantine(spark, []).count() == 0
