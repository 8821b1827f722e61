from conftest import fixture_path
from ledgerlens.operators.categorise import classify_codes
from ledgerlens.sources import read_code_list


def _expected():
    return {
        "POS": "Point-of-Sale Transaction or Proceeds",  # first spelling beats the later "pos"
        "ITR": "Funds Transfer Again",  # a repeated code keeps its last description
        "INSPREM": "Insurance Premium",
        "AWL": "Cash Withdrawal",
    }  # "LONE" has no description line and is ignored


def test_parse_pairs(spark):
    got = {r.code: r.description for r in read_code_list(spark, fixture_path("codes.txt")).collect()}
    assert got == _expected()


def test_parse_pairs_across_many_splits(spark):
    # Tiny splits force the line numbering to run over several file splits.
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40")
    try:
        df = read_code_list(spark, fixture_path("codes.txt"))
        got = {r.code: r.description for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == _expected()


def test_headerless_file(spark, workdir):
    p = f"{workdir}/codes.txt"
    with open(p, "w") as f:
        f.write("INT\nInterest Earned\n\n  FD  \nFixed Deposit Placement\n")
    got = {r.code: r.description for r in read_code_list(spark, p).collect()}
    assert got == {"INT": "Interest Earned", "FD": "Fixed Deposit Placement"}


def test_classified_code_list(spark):
    cats = {r.code: r.category for r in classify_codes(read_code_list(spark, fixture_path("codes.txt"))).collect()}
    assert cats == {"POS": "Shopping", "ITR": "Transfers", "INSPREM": "Government & CPF", "AWL": "Transfers"}


def test_split_alternatives(spark, workdir):
    p = f"{workdir}/alt.txt"
    with open(p, "w") as f:
        f.write("DCR / DCRT\nInstant Direct Credit\nASC / A-SC\nCash Withdrawal Service Charge\n")
    one = {r.code for r in read_code_list(spark, p).collect()}
    split = {r.code: r.description for r in read_code_list(spark, p, split_alternatives=True).collect()}
    assert one == {"DCR / DCRT", "ASC / A-SC"}
    assert split == {"DCR": "Instant Direct Credit", "DCRT": "Instant Direct Credit",
                     "ASC": "Cash Withdrawal Service Charge", "A-SC": "Cash Withdrawal Service Charge"}
