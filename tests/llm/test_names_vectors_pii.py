import random

import numpy as np
import pytest

from quillmesh.llm import names, neighbors, pii

FAMILIES = ["Kosbalatlow", "Naltigudquist", "Bostinarby", "Segnuhulquist", "Janvatodstad", "Valtakassgard", "Merkabimham", "Firduzitby", "Wegnesumby", "Tonvizutstad"]
GIVEN = ["Greta", "Margaret", "Ludwig", "Augustin", "Zelda", "Timothy", "Raymond", "Silke"]
PEOPLE = "id long, name string, aliases string, birthdate string, location string, phone string, profession string, entity string"
HOUSES = "id long, name string, region string, country string, website string, entity string"


def pairs(groups):
    return {(a, b) for g in groups for a in g for b in g if a < b}


def linked(spark, people, houses=()):
    out = names.linked_pairs(spark.createDataFrame(people, PEOPLE), spark.createDataFrame(list(houses), HOUSES))
    rows = [tuple(r) for r in out.collect()]
    assert len(rows) == len(set(rows))
    return {(a, b) for t, a, b in rows if t == "people"}, {(a, b) for t, a, b in rows if t == "producers"}


def person(i, name, born=None, place=None, aliases=None, phone=None):
    return (i, name, aliases, born, place, phone, None, "clash")


def test_people_variants(spark):
    rows, n = [], 0
    for f in FAMILIES:
        for g in GIVEN:
            n += 1
            rows.append(person(n, f"{g} {f}", f"19{n % 90 + 10}-01-01", f"Town{n}", "Peggy" if g == "Margaret" else None))
    by_name = {r[1]: r[0] for r in rows}
    variants = [
        ("Dr. Greta Kosbalatlow", by_name["Greta Kosbalatlow"], {}), ("KOSBALATLOW Greta", by_name["Greta Kosbalatlow"], {}), ("Kosbalatlow, Greta", by_name["Greta Kosbalatlow"], {}),
        ("Greta Kosbàlatlow", by_name["Greta Kosbalatlow"], {}), ("Greta Kos-balatlow", by_name["Greta Kosbalatlow"], {}), ("greta kosbalatlow Jr.", by_name["Greta Kosbalatlow"], {}),
        ("Greta Koslabatlow (cellar)", by_name["Greta Kosbalatlow"], {"place": "Town1"}), ("Peggy Bostinarby", by_name["Margaret Bostinarby"], {}), ("Ludwig Janvatodsta", by_name["Ludwig Janvatodstad"], {}),
        ("Z. Firduzitby", by_name["Zelda Firduzitby"], {}), ("Wegnesumby, T.", by_name["Timothy Wegnesumby"], {}), ("Sparrow Merkabimham", by_name["Silke Merkabimham"], {"aliases": "Silke Merkabimham"}),
        ("Agustin Valtakassgard", by_name["Augustin Valtakassgard"], {}),
    ]
    groups = {}
    for k, (name, of, extra) in enumerate(variants, 1001):
        rows.append(person(k, name, **extra))
        groups.setdefault(of, [of]).append(k)
    rows += [person(2001, "Greta Wegnesumby", "1800-01-01"), person(2002, None), person(2003, ""), person(2004, "Kaja"), person(2005, "Kaja"), person(None, "Greta Kosbalatlow")]
    found, _ = linked(spark, rows)
    assert found == pairs(groups.values())


def test_house_variants(spark):
    house = lambda i, name, region=None, country=None: (i, name, region, country, None, "clash")
    rows = [
        house(1, "Casa Glafustonone", "Silberbrück", "UK"), house(2, "C. Glafustonone", "Silberbrück"), house(3, "THE CASA GLAFUSTONONE LTD"), house(4, "Glafustonone, Casa"),
        house(5, "Brorustenone Vineyards", "Kelderhaven", "ES"), house(6, "Bror-Ustenone Vyds", None, "ES"), house(7, "Brorustennoe Vineyard & Sons"),
        house(8, "Brorustenone Estate", "Ashfeld", "FR"), house(9, "Prisuncisera Estate", "Kelderstow", "UK"), house(10, "Prisuncisera Distillery", "Harrowmere", "US"), house(11, None), house(12, "The"),
    ]
    _, found = linked(spark, [], rows)
    assert found == pairs([[1, 2, 3, 4], [5, 6, 7]])


@pytest.mark.parametrize("growth", [1, 10, 100])
def test_misspelt_given_names_link_at_every_size(spark, growth):
    word = lambda r, k: "".join(r.choice("bdfgklmnprstvz") + r.choice("aeiou") for _ in range(k))
    rng = random.Random(growth)
    cores = [word(rng, 7) for _ in range(90 * growth)]
    met = {
        "cosmo": range(60 * growth), "cosm": range(growth), "cosmos": range(growth, 2 * growth),  # clipped, a letter more
        "celia": range(60 * growth), "delia": range(45 * growth, 90 * growth),  # two names that share a third of their cores
        "ottokar": range(60 * growth), "otto": range(55 * growth, 65 * growth),  # a rarer name, half of its cores shared
        "jana": range(60 * growth), "jan": [*range(growth), *range(61 * growth, 65 * growth)],  # a rare name, a fifth of its cores shared
    }
    rows = [("p", head, cores[k]) for head, ks in met.items() for k in ks]
    rows = [(node, *r) for node, r in enumerate(rows)]
    at = {(head, core): node for node, _, head, core in rows}
    names_df = spark.createDataFrame(rows, "node long, kind string, head string, core string")
    found = {(min(r.a, r.b), max(r.a, r.b)) for r in names.link_names(names_df).collect()}
    want = {tuple(sorted((at["cosmo", cores[k]], at[head, cores[k]]))) for head in ("cosm", "cosmos") for k in met[head]}
    assert want <= found
    if growth > 1:  # five rows of a name are too few to tell it from a misspelling
        assert found == want


def test_slips_in_short_family_names_link(spark):
    cores = ["smith", "smuth", "weber", "wber", "wolters", "wolterss", "kramer", "kraimer", "berger", "bregre", "hansen", "jansen"]
    heads = ["greta"] * 10 + ["ludwig", "silke"]
    rows = [(i, "p", head, core) for i, (head, core) in enumerate(zip(heads, cores))]
    found = {tuple(r) for r in names.link_names(spark.createDataFrame(rows, "node long, kind string, head string, core string")).collect()}
    assert found == {(0, 1), (4, 5), (6, 7)}  # "wber" is too short for the verification, "bregre" too far


def test_names_of_nothing(spark):
    assert linked(spark, []) == (set(), set())


def test_neighbours_recall_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((40, 64))
    x = (centres[rng.integers(0, 40, 1500)] + 0.8 * rng.standard_normal((1500, 64))).astype(np.float32)
    x[100:140] = x[100]  # forty copies
    x[140:143] = 2 * x[100]
    rows = [(i, v.tolist(), "clash") for i, v in enumerate(x)]
    rows += [(5000, None, ""), (5001, [1.0] * 63, ""), (5002, [0.0] * 64, ""), (5003, [float("nan")] * 64, ""), (5004, [float("inf")] * 64, ""), (None, [1.0] * 64, "")]
    df = spark.createDataFrame(rows, "chunk_id long, embedding array<float>, vector string")
    near = neighbors.nearest(df, "chunk_id", "embedding")
    got = {(r.id, r.neighbor_id) for r in near.collect()}
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    cos = np.round(u @ u.T, 9)
    np.fill_diagonal(cos, -2)
    want = {(i, int(j)) for i in range(1500) for j in np.argsort(-cos[i], kind="stable")[:5]}
    assert len(got) == len(want) and len(got & want) >= 0.95 * len(want)
    assert {p for p in got if 100 <= p[0] < 143} == {p for p in want if 100 <= p[0] < 143}
    found = [tuple(r) for r in neighbors.neighbor_pairs(near).collect()]
    assert len(found) == len(set(found)) and all(a < b for a, b in found)
    assert neighbors.nearest(df.where("false"), "chunk_id", "embedding").count() == 0
    assert neighbors.nearest(df.where("chunk_id = 7"), "chunk_id", "embedding").count() == 0


def test_neighbours_of_many_scaled_copies(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((900, 64)).astype(np.float32)
    ids = rng.permutation(100_000)[:900]
    x[:300] = x[0] * np.linspace(0.3, 3.7, 300, dtype=np.float32)[:, None]  # no two bit-equal
    x[300:340] = x[0] + 0.3 * x[300:340]  # rows near the copies have them as neighbours, too
    x[340:400] = (x[0] + 0.3 * x[340]) * np.linspace(0.5, 2, 60, dtype=np.float32)[:, None]
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "chunk_id long, embedding array<float>")
    got = {}
    for r in neighbors.nearest(df, "chunk_id", "embedding").collect():
        got.setdefault(r.id, set()).add(r.neighbor_id)
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    cos = np.round(u @ u.T, 9)
    np.fill_diagonal(cos, -2)
    for i in range(400):
        assert got[ids[i]] == set(ids[np.lexsort((ids, -cos[i]))[:5]].tolist())


TEMPLATES = [
    ("Ask {n} about the barrels.", "person_name"), ("The letter came from {n}.", "person_name"), ("Dr. {n} signed the sheet.", "person_name"), ("talked to {n} about the boat", "person_name"),
    ("Call {p} after six.", "phone"), ("ring me on {p} when you land", "phone"), ("Write to {e} if the date slips.", "email"), ("The form asks for SSN {s}.", "id_number"),
    ("He read out passport no. {i} over the line.", "id_number"), ("They moved to {a} in spring.", "street_address"), ("Order 415-5501-77 shipped.", None), ("Tracking ZX 4471 0921 33 says delayed.", None),
    ("Lot 2024-11-0932 tasted flat.", None), ("Greta says hello to the Mill Street bridge.", None), ("Das alte Regal stand neben einem Krug Wein.", None),
]


def made(rng, template):
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    g, f = rng.choice(GIVEN), rng.choice(FAMILIES)
    values = {
        "n": rng.choice([f"{g} {f}", f"{g} {rng.choice('ABC')}. {f}", f"{f}, {g}", f"{g[0]}. {f}", f"{g} {f}".upper()]),
        "p": rng.choice([f"+1 415 555-0{digits(3)}", f"(617) 555-0{digits(3)}", f"+44 (0)7700 900 {digits(3)}", f"020 7946 0{digits(3)}", f"1-415-555-0{digits(3)} ext. {digits(2)}"]),
        "e": rng.choice([f"{f.lower()}{digits(2)}@harbour.example", f"{f.lower()} at harbour dot example", f"{f.lower()}[at]harbour.example"]),
        "s": f"9{digits(2)}-{digits(2)}-{digits(4)}", "i": f"X{digits(2)} {digits(3)} {digits(3)}",
        "a": rng.choice([f"{digits(3)} Oakcroft Avenue, Apt 5", f"Krummgasse {digits(2)}a", f"{digits(2)} bis quai aux Huiles", f"{digits(3)} Millwood Rd"]),
    }
    slot = template[template.index("{") + 1] if "{" in template else None
    return template.format(**values), values.get(slot)


def test_personal_information_on_held_out_texts(spark):
    rng = random.Random(1)
    people = spark.createDataFrame([(k, f"{g} {f}", None) for k, (g, f) in enumerate((g, f) for g in GIVEN for f in FAMILIES)], "id long, name string, aliases string")
    rows, want = [], {}
    for i in range(900):
        chosen = rng.sample(TEMPLATES, 3)
        parts, values = [], set()
        for t, kind in chosen:
            text, v = made(rng, t)
            parts.append(text)
            if kind:
                values.add((kind, v))
        rows.append(("messages", i, "text", rng.choice([" ", "\n"]).join(parts)))
        want[i] = values
    rows += [("messages", 9000, "text", ""), ("messages", 9001, "text", None), ("messages", 9002, "text", "x " * 50_000)]
    fields = spark.createDataFrame(rows, "source_table string, row_id long, field_name string, text string")
    fields = fields.where("text is not null")
    model = pii.fit_model(fields.where("row_id < 300"), people)
    found = {}
    for r in pii.find_personal(fields.where("row_id >= 300"), model).collect():
        found.setdefault(r.row_id, set()).add((r.kind, r.value))
    truth = {(i, *v) for i, vs in want.items() if i >= 300 for v in vs}
    got = {(i, *v) for i, vs in found.items() for v in vs}
    hit = len(truth & got)
    assert hit / len(truth) > 0.97 and hit / len(got) > 0.97, (sorted(truth - got)[:10], sorted(got - truth)[:10])
    clean = {r.row_id: r.text for r in pii.redact(fields.where("row_id >= 300"), model).collect()}
    assert clean[9002] == "x " * 50_000 and all(v not in clean[i] for i, _, v in truth & got)
    assert pii.find_personal(fields.where("false"), model).count() == 0


def test_names_that_training_never_met(spark):
    rng = random.Random(11)
    people = spark.createDataFrame([(k, f"{g} {f}", None) for k, (g, f) in enumerate((g, f) for g in GIVEN for f in FAMILIES)], "id long, name string, aliases string")
    rows = [("messages", i, "text", " ".join(made(rng, t)[0] for t, _ in rng.sample(TEMPLATES, 3))) for i in range(900)]
    model = pii.fit_model(spark.createDataFrame(rows, "source_table string, row_id long, field_name string, text string"), people)
    given, family = ["John", "Jane", "Priya", "Kwame", "Ingrid", "Pedro", "Wei", "Olga", "Omar", "Sara"], ["Smith", "Doe", "Raghunathan", "Nkrumah", "Solheim", "Almeida", "Zhang", "Petrova", "Haddad", "Okafor"]
    frames = ["Ask {} about the barrels.", "The letter came from {}.", "Dr. {} signed the sheet.", "talked to {} about the boat", "Mr. {} wrote to us."]
    hits = [any(text[a:b] == name and kind == "person_name" for a, b, kind in model.find(text)) for name in (f"{g} {f}" for g in given for f in family) for text in [rng.choice(frames).format(name)]]
    assert sum(hits) >= 0.9 * len(hits), sum(hits)


def test_similar_tokens_share_an_edge(spark):
    nodes = pii.nodes_of("Anna Kosbalatlow met Anna Kosbalatlöw, then Anna Kosbaltlow and Kos-balatlow, Anna.", frozenset(), frozenset(), frozenset())
    pairs = {(nodes[a].text, nodes[b].text) for a, b in pii.similar_tokens(nodes)}
    assert {("Kosbalatlow", "Kosbalatlöw"), ("Kosbalatlöw", "Kosbaltlow"), ("Anna", "Anna")} <= pairs and not any({a, b} >= {"Anna", "Kosbalatlow"} for a, b in pairs)


def test_hot_buckets_are_split_without_loss(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "SPLIT_ROWS", 100)
    monkeypatch.setattr(neighbors, "BLOCK_ROWS", 60)
    rng = np.random.default_rng(9)
    x = rng.standard_normal((500, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "chunk_id long, embedding array<float>")
    got = {(r.id, r.neighbor_id) for r in neighbors.nearest(df, "chunk_id", "embedding").collect()}
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    cos = np.round(u @ u.T, 9)
    np.fill_diagonal(cos, -2)
    assert got == {(i, int(j)) for i in range(500) for j in np.argsort(-cos[i], kind="stable")[:5]}


def test_recall_of_many_buckets_and_other_dimensions(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "BUCKET_ROWS", 128)
    rng = np.random.default_rng(10)
    centres = rng.standard_normal((300, 32))
    x = (centres[rng.integers(0, 300, 4000)] + 0.5 * rng.standard_normal((4000, 32))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "chunk_id long, embedding array<float>")
    got = {(r.id, r.neighbor_id) for r in neighbors.nearest(df, "chunk_id", "embedding", dimensions=32).collect()}
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    cos = np.round(u @ u.T, 9)
    np.fill_diagonal(cos, -2)
    want = {(i, int(j)) for i in range(4000) for j in np.argsort(-cos[i], kind="stable")[:5]}
    assert len(got & want) >= 0.95 * len(want)


def test_model_without_any_data(spark):
    none = spark.createDataFrame([], "source_table string, row_id long, field_name string, text string")
    people = spark.createDataFrame([], "id long, name string, aliases string")
    assert pii.fit_model(none, people).find("Write to a@b.example or call +1 415 555-0100") is not None


@pytest.mark.parametrize("name,tokens", [("Dr. Ann B. Cole-Smith Jr.", ("ann", "colesmith")), ("COLE Ann", ("ann", "cole")), ("Cole, A.", ("a", "cole")), ("Ann", None), ("", None), ("Cole, Jr.", None)])
def test_person_tokens(name, tokens):
    assert names.person_tokens(name) == tokens


@pytest.mark.parametrize("n", [2, 6, 10, 60])
def test_misspellings_link_however_often_they_are_met(spark, n):
    word = lambda r, k: "".join(r.choice("bdfgklmnprstvz") + r.choice("aeiou") for _ in range(k))
    rng = random.Random(n)
    cores, heads = [word(rng, 5) for _ in range(n + 200)], [word(rng, 3) for _ in range(n + 40)]
    rows = [("p", "jonathan", c) for c in cores[: 2 * n]] + [("p", "jonahtan", c) for c in cores[:n]]
    rows += [("p", h, "harrington") for h in heads[: 2 * n]] + [("p", h, "harringtn") for h in heads[:n]]
    rows += [("p", "konstantin", "wolkenstein"), ("p", "konstatin", "wolkenstien")]  # a slip in both
    rows += [("p", rng.choice(heads), c) for c in cores]
    rows = sorted(set(rows))
    at = {(h, c): k for k, (_, h, c) in enumerate(rows)}
    found = {(min(r.a, r.b), max(r.a, r.b)) for r in names.link_names(spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "node long, kind string, head string, core string")).collect()}
    pair = lambda a, b: tuple(sorted((at[a], at[b])))
    want = {pair(("jonathan", c), ("jonahtan", c)) for c in cores[:n]} | {pair((h, "harrington"), (h, "harringtn")) for h in heads[:n]}
    assert want | {pair(("konstantin", "wolkenstein"), ("konstatin", "wolkenstien"))} <= found


def test_trade_words_and_their_forms():
    trades = names.Trades([(w, 0.0) for w in names.TRADES_BEHIND] + [(w, 1.0) for w in names.TRADES_IN_FRONT])
    for name in ("Quabendisac Brewing Company", "Brewing Company Quabendisac", "Quabendisac Brwg.", "Quabendisac Brewers", "The Quabendisac Brewery Ltd"):
        assert trades.tokens(name) == ("brewery", "quabendisac")
    for name in ("Ch. Quabendisac", "Château Quabendisac, S.A.", "Quabendisac, Chateau"):
        assert trades.tokens(name) == ("chateau", "quabendisac")
    assert trades.tokens("Estate") is None and trades.tokens("") is None


def test_classes_and_learned_trades(spark):
    house = lambda i, name: (i, name, "Molenport", "UK", None, "clash")
    rows = [house(k, f"{w} Skola") for k, w in enumerate(["Brimfalont", "Gostaruvek", "Trelimandos", "Pavoskintal"], 1)] + [house(9, "Brimfalont Skla"), house(10, "Gostaruvek Brewing Co.")]
    found = {(r.source_table, r.id): (r.entity, r.n_links) for r in names.entity_classes(spark.createDataFrame([], PEOPLE), spark.createDataFrame(rows, HOUSES)).collect()}
    assert found["producers", 1] == found["producers", 9] == (1, 1) and found["producers", 2] == (2, 0) and found["producers", 10] == (10, 0)
