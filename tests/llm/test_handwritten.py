import random

import pytest

from codeloom.llm.handwritten import file_kinds, kind_of

HAND = "import os\n\n\ndef area(w, h):\n    # do not edit by hand\n    total = 0\n    for x in range(w):\n        if x % 2:\n            total += h\n    return total\n\n\nclass Box:\n    def __init__(self, side):\n        self.side = side\n"
SCHEMA = "file_id bigint, file_path string, language string, code string, kind string, h string"


@pytest.mark.parametrize(
    ("path", "code", "kind"),
    [
        ("src/a.py", HAND, None), ("src/vendor/x/a.py", HAND, "third-party"), ("src/vendoring/a.py", HAND, None), ("vendor_api/generated_check.py", HAND, None), ("web/node_modules/x/i.js", "f()", "third-party"), ("src/generated/a.py", HAND, None), ("src/generator/a.py", HAND, None), ("a_pb2.py", HAND, "generated"), ("x.min.js", "a()", "minified"),
        ("a.py", "# Code generated by tool. DO NOT EDIT.\n" + HAND, "generated"), ("a.py", '"""Generated bindings are read from disk; do not edit them by hand."""\n' + HAND, None), ("a.py", "#!/usr/bin/env python\n# Copyright (c) 2025 the authors.\n#\n# THIS IS AN AUTOMATICALLY GENERATED FILE (x).\n" + HAND, "generated"), ("a.java", '@Generated("x")\npublic class A {}', "generated"),
        ("a.py", HAND + "\n# @generated by tool v1.2\n", "generated"), ("a.py", "# fen 5.1\n# Upstream: the fen project, BSD.\n" + HAND, "third-party"), ("a.js", "/*! fen v1.2.3 | (c) the fen contributors | MIT licence */\nf();\n", "third-party"), ("a.py", "# Copyright (c) 2025 the lumen authors. See the licence file.\n" + HAND, None),
        ("a.js", "!function(e,t){var n=e.a(t);" + "".join(f"if(n){{t=e.q{i}(n)}}" for i in range(200)) + "}(this,0);\n", "minified"), ("a.py", "TEXT = '" + "word " * 150 + "'\n" + HAND, None),
        ("a.py", 'PAYLOAD = "' + "QUJD+/" * 300 + '"\n', "data"), ("a.h", "static const unsigned char x[] = {\n" + "  0x12, 0x34, 0x56, 0x78,\n" * 80 + "};\n", "data"), ("a.js", "export default [" + "[1.5, -2.25]," * 200 + "];", "data"), ("a.py", "id,name,w\n" + "".join(f"{i},some name,0.{i}\n" for i in range(40)), "data"),
        ("a.json", '{"name": "x", "scripts": {"a": "b"}, "notes": ["' + "word " * 300 + '"]}', None), ("a.py", HAND + "TABLE = [\n" + "    (1, 2, 3),\n" * 6 + "]\n", None), ("a.ts", "export const M = {\n" + "".join(f"  f{i}: {{ id: {i}, kind: {i} }},\n" for i in range(30)) + "};\n" + "".join(f"export function getF{i}(m: any) {{ return m.f{i}; }}\n" for i in range(30)), "generated"),
        ("vendor/a.py", "", None), ("vendor/a.py", None, None), ("a.py", "\ufeff\n\n", None), (None, HAND, None),
    ],
)
def test_kinds(path, code, kind):
    assert kind_of(path, None, code) == kind


def test_copies_of_foreign_code(spark, rows):
    given = [(1, "vendor/x/a.py", "python", HAND, "k", "h"), (2, "src/mine.py", None, "\ufeff" + HAND.replace("\n", "\r\n"), "k", "h"), (3, "src/other.py", "", HAND + "x = 1\n", "k", "h"), (4, "vendor/y/__init__.py", "", "", "k", "h"), (5, "src/__init__.py", "", "", "k", "h"), (6, None, None, None, None, None), (2, "src/mine.py", None, HAND, "k", "h"), (7, "src/long.py", "python", HAND * 2000, "k", "h")]
    assert rows(file_kinds(spark.createDataFrame(given, SCHEMA))) == [(1, "third-party"), (2, "third-party")]
    assert file_kinds(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("times", [40, 4000])
def test_word_characters_are_counted_at_every_size(times):
    # long lines, hardly a blank and few word characters: a drawing, not minified code
    rnd = random.Random(1)
    text = "".join("".join(rnd.choices("+-=|*~<>:;", k=600)) + "ab\n" for _ in range(times // 4))
    assert (len(text) > 1 << 16) == (times == 4000)
    assert kind_of("a.css", None, text) is None


def test_comments_that_open_and_close_are_read_whole():
    licence = "".join(f"# Clause {i} of the terms.\n#\n" for i in range(100))
    assert kind_of("a.py", None, licence + "# Upstream: the fen project, BSD.\n" + HAND) == "third-party"
    assert kind_of("a.js", None, "/*\n" + " * Terms.\n\n" * 100 + " * Code generated by tool. DO NOT EDIT.\n */\nf();\n") == "generated"
    assert kind_of("a.py", None, HAND + "\n# @generated by tool v1.2\n" + licence) == "generated"
    assert kind_of("a.py", None, licence + HAND + "# Upstream: the fen project, BSD.\n" + HAND + licence) is None


def test_a_folder_alone_makes_no_file_generated():
    by_hand = 'class Model:\n    """What is stored of a record, and how it is read."""\n\n    def load(self, path):\n        """Read the record at a path."""\n        with open(path) as f:\n            return [line.split() for line in f if line.strip()]\n'
    assert kind_of("src/gen/model.py", "python", by_hand) is None
    assert kind_of("src/gen/model.py", "python", "".join(f'FIELD_{i} = "v{i}"\n' for i in range(20)) + "\ndef f():\n    return 1\n") == "generated"
    assert kind_of("src/gen/model.py", "python", "# Code generated by x. DO NOT EDIT.\n" + by_hand) == "generated"
