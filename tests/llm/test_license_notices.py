"""Notices as they stand in files and books, written by hand and not from the rules."""

import pytest

from zonewright.llm.license_scan import license_spans, license_table

NOTICES = [
    ("elastic-2", "You may not provide the software to third parties as a hosted or managed service, where the service provides users with access to any substantial set of the features."),
    ("proprietary", "No part of this publication may be reproduced, stored or transmitted."),
    ("proprietary", "No part of this book may be reproduced in any form by any electronic or mechanical means."),
    ("proprietary", "This software is the confidential and proprietary information of Example Systems, Inc."),
    ("ncsa", "... to deal with the Software without restriction, including without limitation the rights to use, copy, modify"),
    ("ofl", "1) Neither the Font Software nor any of its individual components, in Original or Modified Versions, may be sold by itself."),
    ("openssl", 'All advertising: "This product includes software developed by the OpenSSL Project"'),
    ("bsd-3-clause", "BSD-3-Clause"),
    ("bsd-2-clause", "license = { text = 'BSD-2-Clause' }"),
    ("0bsd", "0BSD"),
    ("gpl", "This is distributed under the GPL."),
    ("gpl", "GPL"),
    ("gpl", "the General Public License applies"),
    ("lgpl", "LGPL"),
    ("lgpl-2", "LGPL-2.1"),
    ("lgpl-3", "LGPL version 3"),
    ("lgpl", "covered by the Lesser General Public License"),
    ("agpl-3", "released under AGPL v3"),
    ("agpl", "Affero GPL"),
    ("agpl", "the GNU Affero General Public License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that ..."),
    ("zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"),
    ("", "FreeBSD and NetBSD run on it; a third clause of the contract was added."),
    ("", "The managed service may be reproduced without restriction; the font software is confidential."),
]


@pytest.fixture(scope="module")
def labelled(spark):
    docs = spark.createDataFrame([(n, text) for n, (_, text) in enumerate(NOTICES)], "doc_id long, text string")
    return {r.doc_id: r.labels for r in license_table(docs).collect()}


def test_notices(labelled):
    assert [(text, labelled[n]) for n, (label, text) in enumerate(NOTICES) if labelled[n] != label] == []


def test_spans_end_where_their_sentence_does(spark):
    text = "No part of this work may be reproduced. It is fine to ask for permission of the owner of the copyright."
    spans = license_spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().spans
    assert [(s.start, -s.minus_end, s.label) for s in spans] == [(0, 8, "proprietary")]
