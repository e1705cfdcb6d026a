"""License scan, toxicity, quality rules and URL filters."""

import random
import re
import zlib

import pytest

from veilspark.llm import licenses, quality, toxicity, urls


def rows_of(df, *names):
    return sorted(map(tuple, df.select(*names).collect()), key=repr)


# --- licenses


def brute_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    hits, labels = [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        hits += at
        labels |= {label} if at else set()
    return len(words), len(hits), min(hits, default=None), max(hits, default=None), ",".join(sorted(labels))


def test_base_phrases_against_brute_force(frame, odd):
    rng = random.Random(4)
    pool = ["CC", "by", "cc", "general", "public", "License", "all", "rights", "reserved", "é", "x1", "K"]
    docs = odd + [(100 + i, "".join(rng.choice(pool) + rng.choice([" ", "-", "\n", ", "]) for _ in range(rng.randint(0, 40)))) for i in range(200)]
    got = rows_of(licenses.license_scan(frame(docs)), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert got == sorted(((k, *brute_base(t)) for k, t in docs), key=repr)


def brute_labels(docs, templates):
    """Every passage laid at every place of every document; no word is looked up."""
    out = {}
    for k, text in docs:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        at = lambda i: words[i] if 0 <= i < len(words) else None  # noqa: E731, B023
        around = range(-licenses.SLACK, licenses.SLACK + 1)
        found = {}
        for label, notices in templates.items():
            for notice, phrases in notices:
                body = notice.split()
                said = sum(len(p.split()) for p in phrases)
                for shift in range(-len(body) - 4, len(words) + 4):
                    on = sum(any(at(shift + i + d) == w for d in around) for i, w in enumerate(body))
                    if on < said + licenses.LEAST * (len(body) - said):
                        continue
                    starts = [(p.split(), f" {notice} "[: f" {notice} ".index(f" {p} ")].count(" ")) for p in phrases]
                    if all(any(all(at(shift + s + d + j) == w for j, w in enumerate(p)) for d in around) for p, s in starts):
                        found[label] = max(found.get(label, 0), on / len(body))
        out[k] = found
    return out


def test_labels_of_the_index(frame):
    notice, phrases = licenses.TEMPLATES["mit"][0]
    docs = [(1, "intro " * 30 + notice + " more"), (2, notice.replace("hereby", "never")), (3, " ".join(reversed(notice.split()))), (4, "Licensed under CC BY-NC 4.0."), (5, "This work is licensed under the GNU General Public License, version 3.")]
    docs += [(6, "released under CC0"), (7, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software who gives it on"), (8, "obtaining person copy software " * 40)]
    got = {r.doc_id: r for r in licenses.license_scan(frame(docs)).collect()}
    assert got[1].labels == "mit" and got[1].score == 1.0
    assert got[2].labels == "" and got[3].labels == "" and got[3].score == 0
    assert set(got[4].labels.split(",")) == {"cc-by", "cc-by-nc"} and "gpl-3.0" in got[5].labels.split(",")
    assert got[6].labels == "cc0" and got[7].labels == "mit" and got[8].labels == ""
    assert licenses.license_scan(frame(docs).filter("false")).count() == 0


def test_stray_phrases_have_no_label_and_standing_notices_are_not_lost(frame):
    stray = ["we read about the apache license today", "they spoke of the affero general public license and went home", "a mozilla public license party", "the phrase source and binary forms is old"]
    rng = random.Random(5)
    want, docs = {}, [(i, t) for i, t in enumerate(stray)]
    for label, notices in licenses.TEMPLATES.items():
        for notice, _ in notices:
            # the passage's own words stand everywhere else too, so that rare words are not where the passage is
            noise = [rng.choice(notice.split()) for _ in range(150)]
            at = rng.randrange(150)
            want[len(docs)] = label
            docs.append((len(docs), " ".join(noise[:at] + [notice] + noise[at:])))
    got = {r.doc_id: r for r in licenses.license_scan(frame(docs)).collect()}
    assert all(set(got[i].labels.split(",")) <= {"", "gpl"} for i in range(len(stray)))
    assert all(label in got[i].labels.split(",") and got[i].score == 1.0 for i, label in want.items())


def test_labels_against_brute_force(frame, odd):
    rng = random.Random(14)
    notices = [n for every in licenses.TEMPLATES.values() for n, _ in every]
    noise = ["the", "software", "license", "public", "copy", "x1", "é", "by", "cc", "2", "of"]
    docs = [(k, t) for k, t in odd if t is None or len(t) < 1000]
    docs = [(i, t) for i, (_, t) in enumerate(docs)]
    for i in range(80):
        words = [rng.choice(noise) for _ in range(rng.randint(0, 25))]
        for _ in range(rng.randint(0, 2)):
            body = rng.choice(notices).split()
            a = rng.randrange(len(body))
            body = body[a // 2 : a // 2 + rng.randint(5, 80)]
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(body) + 1)
                body[at : at + rng.choice([0, 1])] = [rng.choice(noise)] * rng.choice([0, 1, 2])
            words[rng.randrange(len(words) + 1) : 0] = body
        docs.append((100 + i, rng.choice([" ", ", ", "\n"]).join(words)))
    want = brute_labels(docs, licenses.TEMPLATES)
    assert len({label for found in want.values() for label in found}) > 8
    for r in licenses.license_scan(frame(docs)).collect():
        assert set(filter(None, r.labels.split(","))) == {*want[r.doc_id], *filter(None, r.base_labels.split(","))}, r
        assert r.score == max([0.0, *want[r.doc_id].values(), *([0.5] if r.base_labels else [])])


# --- toxicity


def toxic_corpus(n=600, seed=3):
    rng = random.Random(seed)
    syllables = ["an", "er", "ti", "on", "the", "ha", "sh", "re"]
    insults = ["blorf", "grumkin"]  # known from labels only
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(20, 60))]
        toxic = i % 5 == 0
        for _ in range(3 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(insults) + rng.choice(["", "ist", "ung"]))
        docs.append((i, " ".join(words) + ".", "en", "s"))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_learned_insults_reach_held_out_rows(spark, frame):
    docs, labels = toxic_corpus()
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    df = frame(docs)
    model = toxicity.learn(df, table)
    got = {r.doc_id: r for r in toxicity.score_toxicity(df, model).collect()}
    right = [got[i].predicted == y for i, _, y in labels if got[i].held_out]
    assert len(right) > 100 and sum(right) >= 0.98 * len(right)
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, *_ in labels)
    # labels of held-out rows don't change the model
    flipped = spark.createDataFrame([(i, q, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, q, y in labels], "doc_id long, quality int, toxic int")
    assert toxicity.learn(df, flipped) == model
    kept = {r.doc_id for r in toxicity.keep_clean(df, model).collect()}
    assert kept == {i for i in got if not got[i].predicted} and toxicity.keep_clean(df, model).columns == df.columns


def test_grammar():
    model = toxicity.Model()
    weigh = lambda text: sum(model.clause_weights(text))
    assert weigh("you are an idiot") > weigh("an idiot") > weigh("you are not an idiot") > 0
    assert weigh("she said that idiot") < weigh("that idiot")
    assert weigh("nothing here. all fine") == 0
    assert model.score("") < 0.5 and model.score("you idiot, you stupid moron. you pathetic loser") > 0.7


def test_clauses_look_both_ways():
    model = toxicity.Model()
    weigh = lambda text: sum(model.clause_weights(text))
    assert weigh("kill you") > 0 == weigh("you kill") and weigh("we will destroy the old cache") == 0
    assert weigh("I am going to hunt you down") > weigh("hunt them")
    assert weigh('"you idiot", he said') == weigh('he said "you idiot"') < weigh("you idiot")
    assert weigh("not an idiot") < weigh("not because of what came before, idiot") == weigh("idiot")
    assert weigh("not tired but an idiot") == weigh("an idiot") and weigh("idiot, not me") == weigh("idiot")
    assert weigh("dumbo and dumbwaiter, idiotically") == 0 and weigh("two idiots") == weigh("an idiot")


def test_clauses_against_a_scorer_word_by_word():
    """Every hit weighed by looking at all words before and behind it."""
    T = toxicity
    rng = random.Random(6)
    model = T.Model(["blorf"], {"grum": 0.5})
    pool = ["you", "they", "not", "never", "said", "wrote", "blorfs", "grumkin", "idiot", "kill", "i", "but", "an", "very", *["an", "word", "other"] * 2]
    kinds = {"you": "T", "they": "T", "not": "N", "never": "N", "said": "R", "wrote": "R", "blorfs": "I", "grumkin": "I", "idiot": "I", "kill": "K", "i": "A", "but": "B", "word": "O", "other": "O"}
    for _ in range(400):
        clause = [rng.choice(pool) for _ in range(rng.randint(1, 25))]
        k = [kinds.get(w, "L") for w in clause]
        total = 0.0
        for i, w in enumerate(clause):
            if k[i] not in "IK" or k[i] == "K" and "T" not in k[i + 1 : i + 1 + T.NEAR]:
                continue
            x = (0.5 if w == "grumkin" else 1.0) * (0.5 if k[i] in k[:i] else 1)
            if k[i] == "K":
                x *= 1.5 if "A" in k[max(0, i - T.NEAR) : i] else 1
            else:
                x *= 1.5 if "T" in k[max(0, i - T.NEAR) : i] + k[i + 1 : i + 1 + T.NEAR] else 1
            x *= 0.5 if "R" in k[:i] + k[i + 1 :] else 1
            negation = max((j for j in range(i) if k[j] == "N"), default=None)
            if negation is not None:
                between = k[negation + 1 : i]
                x *= 0.3 if "B" not in between and "R" not in between and between.count("O") < T.SCOPE else 1
            total += x
        got = model.clause_weights(" ".join(clause) + ". all fine here")
        assert abs(sum(got) - total) < 1e-9, clause


def test_frames_tell_negated_and_reported_insults_apart():
    """Rows with the same words, toxic only where an insult or threat is aimed and meant: frames must rank and judge better than hits alone."""
    rng = random.Random(7)
    filler = ["harbour", "lamp", "river", "paper", "green", "walk", "music", "stone"]
    meant = ["you {}", "they are {} people", "you are such an {}", "I will kill you", "we are going to hunt them"]
    harmless = ["she is not an {}", "he said that the {} left", "never an {}", "the {}, they wrote", "we kill the old process", "hunt for a lamp"]

    def rows(n, seed):
        rng.seed(seed)
        out = []
        for i in range(n):
            toxic = i % 2
            parts = [" ".join(rng.choice(filler) for _ in range(rng.randint(4, 9))) for _ in range(6)]
            for _ in range(2):
                parts.insert(rng.randrange(len(parts)), rng.choice(meant if toxic else harmless).format(rng.choice(toxicity.INSULTS[:6])))
            out.append((". ".join(parts) + ".", toxic))
        return out

    def judged(model, held):
        s = [(model.score(t), y) for t, y in held]
        ones, zeros = [x for x, y in s if y], [x for x, y in s if not y]
        auc = sum((a > b) + 0.5 * (a == b) for a in ones for b in zeros) / len(ones) / len(zeros)
        found = [y for x, y in s if x >= toxicity.THRESHOLD]
        return auc, sum(found) / max(1, len(found)), sum(found) / len(ones)

    fitted, held = rows(400, 1), rows(400, 2)
    auc, precision, recall = judged(toxicity.fit(fitted), held)
    plain_auc, plain_precision, plain_recall = judged(toxicity.fit(fitted, frames=False), held)
    assert auc > 0.97 and auc > plain_auc + 0.05
    assert precision > 0.95 and recall > 0.8 and precision * recall > plain_precision * plain_recall + 0.1


def test_a_shared_footer_does_not_make_rows_copies():
    rng = random.Random(8)
    rows = [(" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60)) + "\nall of our usual terms apply here", 1) for _ in range(30)]
    assert toxicity.without_near_copies(rows) == rows
    near = [(rows[0][0].replace("usual", "normal"), 1), (rows[1][0], 1), (rows[2][0], 0)]
    assert toxicity.without_near_copies(rows + near) == [*rows, near[2]]


def test_stems_that_inflect_freely_and_whole_forms():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice(["an", "er", "ti", "on", "ha", "sh"]) for _ in range(rng.randint(1, 3)))
    rows = []
    for i in range(600):
        words = [word() for _ in range(40)]
        if i % 4 == 0:
            words[7], words[20] = "blorf" + word(), "grumkin"
        rows.append((" ".join(words), int(i % 4 == 0)))
    forms, stems = toxicity.learn_forms(rows)
    assert len(stems) == 1 and "blorf".startswith(next(iter(stems))) and forms == ["grumkin"]
    model = toxicity.Model(forms, stems)
    assert model.clause_weights("grumkins") and not model.clause_weights("grumkinate") and model.clause_weights("blorfation")


def test_one_text_is_learned_from_for_each_key(spark, frame):
    docs, labels = toxic_corpus(200)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.learn(frame(docs), table)
    assert toxicity.learn(frame(docs + docs[:50] * 30), table) == model


def test_odd_rows_and_no_labels(spark, frame, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.learn(frame(odd), none)
    assert model == toxicity.Model()
    got = toxicity.score_toxicity(frame(odd), model)
    # by value: empty and NULL texts have the lowest score, the others the scorer's
    want = sorted(((k, k is not None and zlib.crc32(str(k).encode()) % 3 == 1, model.score(t or ""), int(model.score(t or "") >= toxicity.THRESHOLD)) for k, t in odd), key=repr)
    assert rows_of(got, "doc_id", "held_out", "score", "predicted") == want
    assert min(model.score(t or "") for _, t in odd) == model.score("")
    assert toxicity.score_toxicity(frame(odd).filter("false"), model).count() == 0


# --- quality rules


def brute_quality(docs, line_docs, line_share, left):
    from collections import defaultdict

    hosts, idents, sizes = defaultdict(set), {}, defaultdict(set)
    lines = []
    for i, (_, t, _, h) in enumerate(docs):
        norm = lambda x: re.sub("[0-9]+", "0", re.sub(r"[\x20\x09-\x0D]+", " ", x).strip(" ").lower())
        own = {norm(x) for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)}
        lines.append(own)
        idents[i] = frozenset(own)
        if own:
            sizes[h or ""].add(idents[i])
        for x in own:
            hosts[h or "", x].add(idents[i])
    out = []
    for (k, t, _, h), own in zip(docs, lines, strict=True):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        count = {}
        for g in grams:
            count[g] = count.get(g, 0) + 1
        rep = len({p for i, g in enumerate(grams) if count[g] > 1 for p in (i, i + 1, i + 2)})
        raw = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        gone = sum(len(x) for x in own if len(hosts[h or "", x]) > max(line_docs, line_share * len(sizes[h or ""])))
        total = sum(map(len, own))
        failed = len(w) < 50 or 100 * rep > 50 * len(w)
        out.append((k, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(raw) - len(set(raw)), rep, failed, gone, not failed and not (gone and total - gone < left * total)))
    return sorted(out, key=repr)


def test_quality_against_brute_force(frame, odd):
    rng = random.Random(8)
    vocabulary = ["a", "bb", "ccc", "d#", "7", "É"]
    docs = [(k, t, "en", "s") for k, t in odd]
    for i in range(120):
        lines = [" ".join(rng.choice(vocabulary) + (str(rng.randint(0, 10**6)) if rng.random() < 0.8 else "") for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 9))]
        docs.append((100 + i, "\n".join(lines + ["Shared  Line of the host"] * (i % 2) + (["another long shared line " * 12] if i % 3 == 0 else [])), "en", rng.choice(["s", "s", "u", None])))
    df = frame([(k, t, a, s or "") for k, t, a, s in docs])
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_chars", "kept"]
    got = rows_of(quality.quality_rules(df, line_docs=5, line_share=0.1, left_share=0.5), *names)
    docs = [(k, t, a, s or "s") for k, t, a, s in docs]
    want = brute_quality(docs, 5, 0.1, 0.5)
    assert got == want and any(not r[-1] and not r[-3] for r in got)
    assert quality.quality_rules(df.filter("false")).count() == 0


def test_copies_are_not_boilerplate(frame):
    rng = random.Random(1)
    text = "\n".join(" ".join(f"w{rng.randint(0, 9999)}" for _ in range(12)) for _ in range(8))
    got = quality.quality_rules(frame([(i, text) for i in range(200)])).select("kept").collect()
    assert all(r.kept for r in got)


def test_copies_of_one_text_hide_no_shared_line(frame):
    """30 documents share a menu line; 2,000 exact copies of another text in the host are one document more."""
    rng = random.Random(4)
    line = lambda: " ".join("".join(rng.choices("abcdefghij", k=7)) for _ in range(60))
    other = line()
    docs = [(i, line() + "\nhome about contact", "en", "s") for i in range(30)] + [(1_000 + i, other, "en", "s") for i in range(2_000)]
    got = {r.doc_id: r for r in quality.quality_rules(frame(docs)).collect()}
    assert all(got[i].removed_chars == len("home about contact") and got[i].kept for i in range(30))
    assert all(got[1_000 + i].removed_chars == 0 and got[1_000 + i].kept for i in range(2_000))


def test_documents_that_are_mostly_shared_lines(frame):
    """30 menu lines and one line of its own in each document: each document counts, whatever the hashes of the lines."""
    rng = random.Random(2)
    line = lambda n: " ".join("".join(rng.choices("abcdefghij", k=7)) for _ in range(n))
    menu = [line(3) for _ in range(30)]
    docs = [(i, "\n".join([*menu, line(12)]), "en", "s") for i in range(60)] + [(1000 + i, line(70), "en", "s") for i in range(200)]
    got = {r.doc_id: r for r in quality.quality_rules(frame(docs)).collect()}
    assert all(got[i].removed_chars == sum(map(len, menu)) and not got[i].kept for i in range(60))
    assert all(got[1000 + i].kept and got[1000 + i].removed_chars == 0 for i in range(200))


def test_a_line_at_the_limit_stays(frame):
    rng = random.Random(3)
    line = lambda: " ".join("".join(rng.choices("abcdefghij", k=7)) for _ in range(60))
    docs = [(i, line() + "\nthe footer", "en", "a" if i < 20 else "b") for i in range(41)]
    got = {r.doc_id: r.removed_chars for r in quality.quality_rules(frame(docs)).collect()}
    assert all(got[i] == (0 if i < 20 else len("the footer")) for i in range(41))


def test_lines_above_the_limit_are_removed(frame):
    rng = random.Random(6)
    line = lambda: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(60))
    body = {i: (line(), line()) for i in range(90)}
    # the footer stands in each document, with other digits and spaces; the same line is not above the limit of the other host
    docs = [(i, f"{a}\n\n Page  {i} of THE site\n{b}\npage 7 of the site", "en", "s") for i, (a, b) in body.items()]
    docs += [(100, body[0][0] + "\npage 1 of the site", "en", "u"), (None, line() + "\npage 1 of the site", "en", "s"), (101, "page 1 of the site\n" * 30, "en", "s"), (102, None, "en", "s")]
    df = frame(docs)
    out = quality.kept_documents(df)
    assert out.schema == df.schema
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == out.count() == 92 and all(r.n_chars == len(r.text) for r in got.values())
    assert all(got[i].text == f"{a}\n\n{b}" for i, (a, b) in body.items())
    assert got[100].text == docs[90][1] and got[None].text == docs[91][1].split("\n")[0]
    assert quality.kept_documents(df.filter("false")).count() == 0


# --- URLs


def brute_url(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    m = re.match(r"(?s)([^/?#]*)([^?#]*)", rest)
    host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]
    fits = [(len(h), len(p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fits)[2:] if fits else (None, "block" if host == "" else "allow")
    return host, path, rule, verdict


def test_urls_against_brute_force(spark):
    rng = random.Random(2)
    hosts = ["example.com", "WWW.example.com", "a.b.www.example.com", "xexample.com", "net", "b.net", "com", "com.", "..com", "example.com:80", "", "é.net", "org"]
    paths = ["", "/", "/en", "/en/", "/en/x/y?q=/es/", "//en/", "/es/1", "/fr/#/", "/EN/", "?/en/", "#", "/a\nb/"]
    links = [f"http://{h}{p}" for h in hosts for p in paths] + [None, "", "no scheme/en/", "x://", "a://b://c/en/", "http://example.com/en/" + "d/" * 5000, "http://" + "s." * 3000 + "net/es/"]
    rows = [(i, u, "clash") for i, u in enumerate(links)] + [(1, links[1], "clash"), (None, rng.choice(links), "clash")]
    df = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = rows_of(urls.url_filter(df, urls.rule_table(spark)), "page_id", "host", "path", "rule", "verdict")
    assert got == sorted(((i, *brute_url(u)) for i, u, _ in rows), key=repr)
    assert urls.url_filter(df.filter("false"), urls.rule_table(spark)).count() == 0
    with pytest.raises(ValueError):
        urls.rule_table(spark, [("allow", "com", "en")])
