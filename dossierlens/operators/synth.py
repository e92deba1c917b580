"""Synthetic document text, injected faults, recognition noise and training rows, all as column expressions.

Random choices are hashes of a row key, so a retried task writes the same rows.
"""

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from dossierlens.operators import joins, ranking

LAYOUTS = 3
# Visually confused character pairs and the noise alphabet.
CONFUSIONS = [
    ("l", "I"), ("I", "l"), ("1", "l"), ("l", "1"), ("0", "O"), ("O", "0"), ("rn", "m"), ("m", "rn"), ("cl", "d"),
    ("vv", "w"), ("ii", "n"), ("§", "S"), ("€", "E"), ("à", "a"), ("é", "e"), ("è", "e"), ("ê", "e"), ("ù", "u"),
    ("â", "a"),
]
NOISE_CHARS = "ceoasiIlO01"


def _line(prefix: str, value: Column, suffix: str = "") -> Column:
    """One line of text, NULL (and later skipped) when its value is."""
    return F.concat(F.lit(prefix), value, F.lit(suffix))


def _day_month_year(iso: Column) -> Column:
    return F.concat_ws("/", F.substring(iso, 9, 2), F.substring(iso, 6, 2), F.substring(iso, 1, 4))


def _money(amount: Column) -> Column:
    return amount.cast("decimal(18,2)").cast("string")


def _date_line(prefix: str, iso: Column) -> Column:
    return F.when(iso.isNotNull(), _line(prefix, _day_month_year(iso)))


def _text(*lines) -> Column:
    return F.concat_ws("\n", *[F.lit(x) if isinstance(x, str) else x for x in lines])


def _invoice_texts(c) -> list:
    name, address = c("raison_sociale"), _line("", c("adresse"), ".")
    siret, tva_no = _line("SIRET : ", c("siret"), " (siège)"), _line("N° TVA : ", c("tva_number"))
    ht, tva, ttc = (_money(c(x)) for x in ("montant_ht", "montant_tva", "montant_ttc"))
    rate = c("taux_tva").cast("string")
    issued, due, number = c("date_emission"), c("date_echeance"), c("numero_document")
    closing = "Pénalités de retard exigibles sans rappel, indemnité forfaitaire due pour toute facture impayée."
    return [
        _text(name, address, siret, tva_no, _line("FACTURE N° ", number),
              _date_line("Date d'émission : ", issued), _date_line("Date d'échéance : ", due),
              "Vendeur et acheteur désignés au contrat, mode de règlement : virement.",
              _line("Total HT : ", ht, " €"), F.concat(F.lit("TVA "), rate, F.lit("% : "), tva, F.lit(" €")),
              _line("TOTAL TTC : ", ttc, " €"), closing),
        _text("FACTURE", _line("N° de facture : ", number),
              _date_line("Date de facturation : ", issued), _date_line("Date de paiement : ", due),
              _line("Raison sociale : ", name), address, siret, tva_no,
              _line("Montant HT : ", ht, " €"), _line("Taux de TVA ", rate, " %"),
              _line("Montant TVA : ", tva, " €"), _line("Montant TTC : ", ttc, " €"), closing),
        _text("DOCUMENT DE FACTURATION", _line("Ref. facture : ", number),
              _date_line("Émis le ", issued), _date_line("Payable le ", due),
              _line("Raison sociale : ", name), address, siret, tva_no,
              "Règlement de la présente facture sans escompte.",
              _line("Montant HT : ", ht, " €"), _line("dont TVA : ", tva, " €"),
              _line("Net à payer : ", ttc, " €"), closing),
    ]


def _quote_texts(c) -> list:
    name, address = c("raison_sociale"), _line("", c("adresse"), ".")
    siret, tva_no = _line("SIRET : ", c("siret"), " (siège)"), _line("N° TVA : ", c("tva_number"))
    ht, tva, ttc = (_money(c(x)) for x in ("montant_ht", "montant_tva", "montant_ttc"))
    rate = c("taux_tva").cast("string")
    issued, until, number = c("date_emission"), c("date_expiration"), c("numero_document")
    closing = ["Prestations proposées sous réserve d'acceptation, acompte de 30 % à la commande.",
               "Bon pour accord, devis non contractuel avant signature."]
    return [
        _text(name, address, siret, tva_no, _line("DEVIS N° ", number),
              _date_line("Date d'établissement : ", issued), _date_line("Valable jusqu'au : ", until),
              _line("Sous-total HT : ", ht, " €"), F.concat(F.lit("TVA "), rate, F.lit("% : "), tva, F.lit(" €")),
              _line("Total TTC : ", ttc, " €"), *closing),
        _text("PROPOSITION COMMERCIALE", _line("Offre n° ", number),
              _date_line("Fait le ", issued), _date_line("Date de validité : ", until),
              _line("Raison sociale : ", name), address, siret, tva_no,
              _line("Total HT : ", ht, " €"), _line("Taux de TVA ", rate, " %"),
              _line("Montant TVA : ", tva, " €"), _line("Total TTC : ", ttc, " €"), *closing),
        _text("OFFRE DE SERVICES", _line("N° du devis : ", number),
              _date_line("Date du document\nDate de document : ", issued), _date_line("Expire le ", until),
              _line("Raison sociale : ", name), address, siret, tva_no,
              _line("Base HT : ", ht, " €"), _line("Montant TVA : ", tva, " €"),
              _line("Total général : ", ttc, " €"), *closing),
    ]


def _certificate_texts(c) -> dict:
    name = _line("Raison sociale : ", c("raison_sociale"))
    address = _line("Adresse : ", c("adresse"), ".")
    siret = _line("SIRET : ", c("siret"), " (siège)")
    issued, until = c("date_emission"), c("date_expiration")
    spaced_iban = F.concat_ws(" ", *[F.substring(c("iban"), start, n) for start, n in
                                     ((1, 4), (5, 5), (10, 5), (15, 11), (26, 2))])
    return {
        "SIRET": _text("ATTESTATION DE SITUATION AU RÉPERTOIRE SIRENE",
                       "Délivrée par l'INSEE d'après le répertoire national des entreprises",
                       name, address, _line("Numéro SIRET : ", c("siret"), " (siège)"),
                       "Établissement actif, code APE attribué.", _date_line("Date d'édition : ", issued)),
        "URSSAF": _text("ATTESTATION DE VIGILANCE - URSSAF", name, address, siret,
                        "Cotisations sociales et contributions patronales en règle.",
                        "Code de la sécurité sociale, contrôle sur net-entreprises.",
                        _date_line("Date d'émission : ", issued), _date_line("Valable jusqu'au : ", until)),
        "KBIS": _text("EXTRAIT KBIS - REGISTRE DU COMMERCE", name, address, siret,
                      _line("N° TVA : ", c("tva_number")),
                      "Immatriculation au RCS, forme juridique et capital social déclarés.",
                      _date_line("Date d'édition : ", issued),
                      "Certifié par le greffier du tribunal de commerce, gérant inscrit."),
        "RIB": _text("RELEVÉ D'IDENTITÉ BANCAIRE", "Titulaire du compte ci-dessous.", name, address, siret,
                     _line("IBAN : ", F.when(c("iban").isNotNull(), spaced_iban), " ;"),
                     _line("BIC : ", c("bic"), " ;"), _line("Domiciliation : ", c("banque")),
                     "Code guichet et clé RIB repris pour tout virement ou prélèvement."),
    }


def render_documents(df: DataFrame, layout: Column = None, output: str = "ocr_text") -> DataFrame:
    """Write each row's fields as administrative text; a NULL field leaves its line out.

    ``layout`` picks one of three layouts of invoices and quotes; by default a hash of the document id does.
    """
    layout = F.pmod(F.xxhash64("document_id"), F.lit(LAYOUTS)) if layout is None else layout
    doc_type = F.col("doc_type")
    text = F
    for kind, variants in (("FACTURE", _invoice_texts(F.col)), ("DEVIS", _quote_texts(F.col))):
        for i, variant in enumerate(variants):
            text = text.when((doc_type == kind) & (layout == i), variant)
    for kind, variant in _certificate_texts(F.col).items():
        text = text.when(doc_type == kind, variant)
    return df.withColumn(output, text)


def inject_anomaly(df: DataFrame, as_of: datetime, spread: Column = None) -> DataFrame:
    """Apply the planned ``anomaly``: ``bad_siret`` takes ``next_siret`` (another company's valid number), ``expired``
    moves the dates before ``as_of`` by a number of days that depends on the row."""
    spread = F.xxhash64("document_id") if spread is None else spread
    day = F.lit(as_of.date())
    expired = F.coalesce(F.col("anomaly") == "expired", F.lit(False))
    is_kbis = F.col("doc_type") == "KBIS"

    def back(least, span):
        return F.date_sub(day, (F.lit(least) + F.pmod(spread, F.lit(span))).cast("int")).cast("string")

    return df.withColumns({
        "siret": F.when(F.col("anomaly") == "bad_siret", F.col("next_siret")).otherwise(F.col("siret")),
        "date_emission": F.when(expired & is_kbis, back(91, 275)).when(expired, back(181, 185))
        .otherwise(F.col("date_emission")),
        "date_expiration": F.when(expired & ~is_kbis, back(1, 180)).otherwise(F.col("date_expiration")),
    })


def plan_documents(suppliers: DataFrame, as_of: datetime) -> DataFrame:
    """Seed documents of every supplier: plan, neighbour's SIRET, dates around ``as_of`` and injected faults."""
    with_next = ranking.next_row(suppliers, "supplier_id", ["siret"])
    planned = joins.expand_document_plan(with_next)
    day = as_of.date()
    dated = planned.withColumns({
        "document_id": F.sha2("seed_key", 256),
        "date_emission": F.lit((day - timedelta(days=10)).isoformat()),
        "date_expiration": F.when(
            F.col("doc_type").isin("DEVIS", "URSSAF"), F.lit((day + timedelta(days=60)).isoformat())),
    })
    return inject_anomaly(dated, as_of, F.col("supplier_index"))


def uniform(*keys) -> Column:
    """Reproducible draw in [0, 1) from the hash of the keys."""
    return F.pmod(F.xxhash64(*[F.lit(k) if isinstance(k, (int, str)) else k for k in keys]), F.lit(1_000_003)) / 1_000_003.0


def _draw(n: Column, *keys) -> Column:
    return F.floor(uniform(*keys) * n).cast("int")


def augment_text_noise(df: DataFrame, severity: Column, key: str, text_col: str = "text", seed: int = 42) -> DataFrame:
    """Damage text line by line: lost lines, confused characters, wrong letters, split words and merged words.

    Each kind of damage is one pass over the array of lines, because nesting the passes in one expression would repeat
    the inner ones.
    """
    id_ = F.col(key)

    def u(i, step):
        return uniform(id_, i, seed, step)

    def blank(line):
        return F.trim(line) == ""

    def lose(line, i):
        return blank(line) | (severity <= 0.4) | (u(i, 1) >= severity * 0.06)

    sources = F.array(*[F.lit(a) for a, _ in CONFUSIONS])
    targets = F.array(*[F.lit(b) for _, b in CONFUSIONS])

    def confuse(line, i):
        choice = _draw(F.lit(len(CONFUSIONS)), id_, i, seed, 3)
        source, target = F.get(sources, choice), F.get(targets, choice)
        at = F.position(source, line)
        return F.when((u(i, 2) < severity * 0.5) & (at > 0), F.concat(
            F.substring(line, 1, at - 1), target, F.substring(line, at + F.length(source), F.length(line))
        )).otherwise(line)

    def mistake(line, i):
        at = _draw(F.length(line) - 3, id_, i, seed, 5) + 3
        hit = (u(i, 4) < severity * 0.15) & (F.length(line) > 5) & F.substring(line, at, F.lit(1)).rlike(r"\p{L}")
        noise = F.substring(F.lit(NOISE_CHARS), _draw(F.lit(len(NOISE_CHARS)), id_, i, seed, 6) + 1, F.lit(1))
        return F.when(hit, F.concat(
            F.substring(line, 1, at - 1), noise, F.substring(line, at + 1, F.length(line)))).otherwise(line)

    def words_of(line):
        return F.split(F.trim(F.regexp_replace(line, r"\s+", " ")), " ")

    def split_word(line, i):
        words = words_of(line)
        at = _draw(F.size(words), id_, i, seed, 8)
        word = F.get(words, at)
        cut = _draw(F.length(word) - 3, id_, i, seed, 9) + 2
        hit = ~blank(line) & (u(i, 7) < severity * 0.12) & (F.length(word) >= 5)
        return F.when(hit, F.array_join(F.transform(words, lambda w, j: F.when(j == at, F.concat(
            F.substring(w, 1, cut), F.lit(" "), F.substring(w, cut + 1, F.length(w)))).otherwise(w)), " ")
        ).otherwise(line)

    def merge_words(line, i):
        words = words_of(line)
        at = _draw(F.size(words) - 1, id_, i, seed, 11)
        hit = ~blank(line) & (u(i, 10) < severity * 0.08) & (F.size(words) >= 2)
        glued = F.transform(words, lambda w, j: F.when(j == at + 1, w).when(j == 0, w).otherwise(
            F.concat(F.lit(" "), w)))
        return F.when(hit, F.array_join(glued, "")).otherwise(line)

    lines = F.filter(F.split(F.col(text_col), "\n"), lose)
    for step in (confuse, mistake, split_word, merge_words):
        lines = F.transform(lines, step)
    return df.withColumn(text_col, F.when(severity.isNull() | (severity <= 0), F.col(text_col)).otherwise(
        F.array_join(lines, "\n")))


def training_dataset(df: DataFrame, key: str, schedule: list = None, seed: int = 42) -> DataFrame:
    """Mix clean and damaged copies of ``text, label`` rows; adds the noise ``band``. Rows stay unordered: any later
    shuffle of the training rows is the trainer's own."""
    band = joins.lookup_band(uniform(F.col(key), seed, 100), schedule)
    placed = df.withColumn("_band", band)
    low, high = F.col("_band.severity_lo"), F.col("_band.severity_hi")
    severe = placed.withColumn("_severity", low + (high - low) * uniform(F.col(key), seed, 101))
    return augment_text_noise(severe, F.col("_severity"), key, "text", seed).withColumn(
        "band", F.col("_band.band")).drop("_band", "_severity")
