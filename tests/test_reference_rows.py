"""Landed reference rows: ordinals, hashes, reasons."""

import hashlib
import json

from evloom.operators import alignment as al
from evloom.sources import reference


def test_rows_are_numbered_and_refused_with_a_reason(spark, tmp_path):
    good = [json.dumps({"DOI": f"https://doi.org/10.1234/A{i}", "pH": i / 2, "Oil_Type": "oil" if i % 2 else None, "kept": True}) for i in range(6)]
    bad = {"{broken": "no JSON object", "[1, 2]": "no JSON object", '"text"': "no JSON object", '{"DOI": "10.1234/x", "a": [1]}': "nested field",
           '{"DOI": "10.1234/x", "a": {"b": 1}}': "nested field", '{"DOI": "none"}': "no valid DOI", "{}": "no valid DOI",
           '{"DOI": "10.1234/x", "a": 1, "a": 2}': "no JSON object"}
    files = [good[:2] + list(bad)[:3], [""] + good[2:] + list(bad)[3:], []]
    for name, lines in zip(("a.json", "b.json", "c.json"), files):
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    lines = [line for part in files for line in part if line]
    rows = {r["reference_row_id"]: r for r in reference.read_reference_rows(spark, str(tmp_path)).collect()}
    assert sorted(rows) == list(range(1, len(lines) + 1))
    for i, line in enumerate(lines, 1):
        r = rows[i]
        assert (r["raw"], r["row_hash"], r["reason"]) == (line, hashlib.sha256(line.encode()).hexdigest(), bad.get(line))
        want = json.loads(line)["DOI"].removeprefix("https://doi.org/").lower() if line in good else None
        assert r["doi"] == r["study_family"] == want and r["origin"] == ("manual_original" if want else None)
    assert rows[1]["fields"] == {"DOI": "https://doi.org/10.1234/A0", "pH": "0.0", "Oil_Type": None, "kept": "true"}
    wide = reference.reference_columns(reference.read_reference_rows(spark, str(tmp_path)), ["Oil_Type", "pH", "absent"])
    assert wide.count() == 6 and al.reference_violations(wide).count() == 0
    melted = al.reference_fields(wide, ["Oil_Type", "pH", "absent"])
    assert {(r["doi"], r["field"], r["reference"]) for r in melted.collect()} == {
        *((f"10.1234/a{i}", "pH", str(i / 2)) for i in range(6)), *((f"10.1234/a{i}", "Oil_Type", "oil") for i in (1, 3, 5))}


def test_empty_folder_has_no_rows(spark, tmp_path):
    (tmp_path / "none.json").write_text("\n\n")
    assert reference.read_reference_rows(spark, str(tmp_path)).count() == 0
