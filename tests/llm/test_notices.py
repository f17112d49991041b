"""Altered notices, and licences near another one."""

from llm_rows import frame

from gsx.llm.licenses import Matcher
from gsx.llm.notices import TEXTS
from gsx.llm.queries import op5_licenses

NOTICES = {
    "Licensed under the MIT License.": "MIT-notice",
    "distributed under the terms of the GNU Lesser General Public License, version 2.1": "LGPL-2.1-notice",
    "Released under the GNU GPL v2": "GPL-2.0-notice",
    "licensed under the AGPLv3": "AGPL-3.0-notice",
    "SPDX-License-Identifier: EPL-2.0": "EPL-2.0-notice",
    "This text is under CC BY-NC-SA 3.0": "CC-BY-NC-SA-3.0-notice",
    "Available under a Creative Commons Attribution-NonCommercial 4.0 International License": "CC-BY-NC-4.0-notice",
    "(c) 2020 Somebody\nAll rights reserved.\nA story.": "all-rights-reserved",
}


def test_altered_notices(spark, tmp_path):
    rows = [(i, t, "a") for i, t in enumerate(NOTICES)] + [(99, "the house under the mitigation act", "a"), (98, None, "a")]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["doc_id"], r["license"]) for r in op5_licenses(spark, str(tmp_path)).collect()}
    assert got == set(enumerate(NOTICES.values()))


def test_near_licences():
    matcher = Matcher(TEXTS)
    for name in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "BSD-3-Clause", "ISC", "Apache-2.0", "EPL-2.0"):
        assert set(matcher.distinct(f"some words here {TEXTS[name]} and more".encode())) == {name}
    both = f"{TEXTS['GPL-2.0']} or else {TEXTS['AGPL-3.0']}".encode()
    assert {"GPL-2.0", "AGPL-3.0"} <= set(matcher.distinct(both))
