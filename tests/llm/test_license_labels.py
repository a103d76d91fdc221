"""Labels of licence notices that are near each other, headers that stand alone, and the cost of texts dense in phrases."""

import time

import pyarrow as pa
import pytest

from petriflow.llm import license_scan

CASES = {
    "GNU Lesser General Public License version 3": {"lgpl"},
    "GNU Affero General Public License version 3": {"agpl"},
    "the lesser general public license version 2": set(),
    "GNU General Public License version 3": {"gpl", "gpl-3.0"},
    "Licensed under the GNU General Public License version 2": {"gpl", "gpl-2.0"},
    "Apache License, Version 2.0": {"apache-2.0"},
    "Apache License, Version 1.1 ": set(),
    "MIT License": {"mit"},
    "# MIT License\n\nsome text": {"mit"},
    "a word of the MTI License": set(),
    "Mozilla Public License, v. 2.0": {"mpl-2.0"},
    "Eclipse Public License - v 2.0": {"epl-2.0"},
    "Apache-2.0": {"apache-2.0"},
    "x apache-2.0 x": set(),
    "// SPDX-License-Identifier: MIT": {"mit"},
    "SPDX-License-Identifier: GPL-3.0-only": {"gpl-3.0"},
    "SPDX-License-Identifier: LGPL-3.0-only": {"lgpl"},
}


def test_labels(spark):
    docs = spark.createDataFrame([*enumerate(CASES)], "doc_id long, text string")
    got = {r.text: {n.label for n in r.notices} for r in license_scan.scan(docs).collect()}
    assert got == CASES


def test_places_in_words(spark):
    docs = spark.createDataFrame([(1, "é one\ntwo MIT License\nMIT License\nx cc by the Apache License, Version 2.0 end cc-by")], "doc_id long, text string")
    r = license_scan.scan(docs).first()
    assert r.n_words == 19 and [(p.label, p.start_word, p.end_word) for p in r.phrases] == [("cc-by", 8, 10), ("cc-by", 17, 19)]
    assert [(n.label, n.start_word, n.end_word) for n in r.notices if n.errors == 0] == [("mit", 5, 7), ("apache-2.0", 11, 16)]


@pytest.mark.parametrize(("unit", "size"), [("cc by foo ", 1_000_000), ("all rights reserved ", 100_000), ("gnu general public license version 2 ", 50_000), ("MIT License\n", 50_000)])
def test_cost_grows_with_the_text(unit, size):
    run, took = license_scan._scanning(license_scan.NOTICES, license_scan.BASE, []), []
    for n in (size, 4 * size):
        batch = pa.RecordBatch.from_arrays([pa.array([unit * (n // len(unit))])], ["text"])
        began = time.perf_counter()
        list(run(iter([batch])))
        took.append(time.perf_counter() - began)
    assert took[1] < 8 * max(took[0], 0.5)
