"""Layouts of several banks: found by header or content, brought to the same rows."""

import os

import pytest
from pyspark.sql import Observation

from ledgerlens.operators.clean import clean_statements
from ledgerlens.sources.layouts import DEFAULT_LAYOUT, MARKER_LAYOUT, SIGNED_LAYOUT, Layout, UnknownLayoutError, detect
from ledgerlens.sources.statements import read_layouts

ROWS = [("2025-02-01", -10.0, "KOPITIAM, BEDOK"), ("2025-02-03", 2500.0, "SALARY CREDIT"), ("2025-12-04", -3.5, "BUS")]

FILES = {
    "default.csv": 'Transaction Date,Transaction Code,Description,Withdrawal Amount,Deposit Amount\n'
                   '01/02/2025,POS,"KOPITIAM, BEDOK",10.00,\n03/02/2025,,SALARY CREDIT,,2500\n04/12/2025,,BUS,3.50,\n',
    "signed.csv": 'details, DATE ,Amount,Balance\n"KOPITIAM, BEDOK",01/02/2025,-10.00,7\nSALARY CREDIT,03/02/2025,+2500,8\nBUS,04/12/2025,(3.50),9\n',
    "marker.csv": 'Posting Date,Narrative,Amount,DR/CR\n02/01/2025,"KOPITIAM, BEDOK",10.00,dr\n2/3/2025,SALARY CREDIT,2500,CR\n12/04/2025,BUS,3.50,Debit\n',
    "bare_marker.csv": '02/01/2025,"KOPITIAM, BEDOK",10.00,DR\n02/03/2025,SALARY CREDIT,2500.00,CR\n12/04/2025,BUS,3.50,DR\n',
    "bare_signed.csv": '2025-02-01,"KOPITIAM, BEDOK",-10\n2025-02-03,SALARY CREDIT,2500\n2025-12-04,BUS,3.50-\n',
    "bare_default.csv": '01/02/2025,POS,"KOPITIAM, BEDOK",10.00,\n03/02/2025,,SALARY CREDIT,,2500\n04/12/2025,,BUS,3.50,\n',
}


def put(folder, name, text):
    path = os.path.join(folder, name)
    with open(path, "w") as f:
        f.write(text)
    return path


def rows(df):
    got = clean_statements(df).select("transaction_date", "amount", "description").collect()
    return sorted((str(r[0]), float(r[1]), r[2]) for r in got)


@pytest.mark.parametrize("name", sorted(FILES))
def test_each_layout_gives_the_same_rows(spark, workdir, name):
    assert rows(read_layouts(spark, put(workdir, name, FILES[name]))) == sorted(ROWS)


def test_mixed_folder(spark, workdir):
    for name, text in FILES.items():
        put(workdir, name, text)
    df = read_layouts(spark, workdir)
    assert rows(df) == sorted(ROWS * len(FILES))
    assert df.select("seq").distinct().count() == 3 * len(FILES)
    assert clean_statements(df).where("transaction_code = 'POS'").count() == 2


def test_unreadable_cells_are_counted(spark, workdir):
    put(workdir, "m.csv", "Posting Date,Narrative,Amount,DR/CR\n31/12/2025,A,1.00,DR\n12/31/2025,B,2.00,??\n12/31/2025,C,x,CR\n12/31/2025,D,,CR\n")
    put(workdir, "s.csv", "Date,Details,Amount\n31/12/2025,E,--5\n31/12/2025,F,(-5)\n31/12/2025,G,\n31/12/2025,H,-\n")
    seen = Observation("layout_counts")
    assert clean_statements(read_layouts(spark, workdir), observation=seen).collect() == []
    got = seen.get
    # A: a day where the month belongs; B, C, E, F, H: no amount that can be read; D, G: blank.
    assert (got["raw_rows"], got["bad_dates"], got["rejected_amounts"], got["zero_amounts"]) == (8, 1, 5, 7)


def test_money_out_may_be_positive(spark, workdir):
    card = Layout("card", {"date": "When", "description": "Where", "amount": "Charge"}, out_is_positive=True)
    put(workdir, "c.csv", "When,Where,Charge\n2025-01-01,SHOP,5\n2025-01-02,REFUND,-2\n")
    assert rows(read_layouts(spark, workdir, layouts=(card,))) == [("2025-01-01", -5.0, "SHOP"), ("2025-01-02", 2.0, "REFUND")]


def test_detection_and_its_error(spark, workdir):
    assert detect("Transaction Date,Description,Withdrawal Amount,Deposit Amount") == (DEFAULT_LAYOUT, True)
    assert detect("Amount,DR/CR,Narrative,Posting Date") == (MARKER_LAYOUT, True)
    assert detect('"Date","Details","Amount","Type"') == (SIGNED_LAYOUT, True)
    assert detect("3 Feb 2025,BUS,-1") == (SIGNED_LAYOUT, False)
    with pytest.raises(UnknownLayoutError) as e:
        detect("Date,Details,Sum")
    assert e.value.missing == ["Amount"] and "signed amount" in str(e.value)
    put(workdir, "u.csv", "Posting Date,Narrative,Amount\n02/01/2025,BUS,1\n")
    with pytest.raises(UnknownLayoutError, match="DR/CR"):
        read_layouts(spark, workdir)
