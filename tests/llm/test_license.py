import re

from lineloom.llm.license_scan import PHRASES, scan_licenses

from .helpers import CLASHES, rows_of

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def base(text):
    w = WORD.findall((text or "").translate(UPPER))
    at, labels = [], set()
    for phrase, label in PHRASES:
        hits = [i for i in range(len(w) - len(phrase) + 1) if tuple(w[i : i + len(phrase)]) == phrase]
        at += hits
        labels |= {label} if hits else set()
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


TEXTS = [
    None,
    "",
    "...",
    "MIT License. The MIT license; mit-license MITlicense",
    "general public general public license apache license",
    "GENERAL\nPUBLIC\tLICENSE ÀMIT License mit É license",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "Redistribution and also use in source and binary forms, with or without modification, are permitted provided that following conditions are met",
    "Permission is hereby granted, free of charge, to any person",
    "nothing to see",
    "mit license " * 20_000,
    "filler words here " * 5000 + "This work is licensed under a Creative Commons Attribution 4.0",
]


def test_base_counts(make_docs):
    rows = [*enumerate(TEXTS), (3, TEXTS[3]), (3, TEXTS[3]), (None, TEXTS[4]), (5, "other text of the same id")]
    out = scan_licenses(make_docs(rows, extra=CLASHES))
    assert rows_of(out, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == sorted([(i, *base(t)) for i, t in rows], key=repr)


def test_labels_of_the_voting(make_docs):
    out = {r.doc_id: r for r in scan_licenses(make_docs(TEXTS)).collect()}
    assert out[6].labels == "bsd" and out[6].base_labels == "" and out[6].score == 1.0
    assert out[7].labels == "bsd" and 0.6 <= out[7].score < 1  # words put in and left out
    assert out[8].labels == "" and out[9].labels == "" and out[9].score == 0
    assert out[11].labels == "cc" and out[4].labels == "apache,gpl" and out[4].score == 1.0
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in out.values())


def test_empty_tables(make_docs):
    assert scan_licenses(make_docs([])).collect() == []


def test_documents(spark, sf_dir):
    from lineloom.llm.queries import queries

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    out = queries()["op4_license_scan"](spark, sf_dir)
    assert rows_of(out, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == sorted([(r.doc_id, *base(r.text)) for r in docs], key=repr)
