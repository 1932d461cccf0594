"""CSV input: columns bound by header name, optional columns, lenient dates."""
import pytest

from shopsignal.operators import baskets, cleaning
from shopsignal.sources.retail import load_retail_csv

FILES = {
    "transactions": "BasketID,SaleTransactionDate,ClientID,Quantity,ProductID,SalesNetAmountEuro,StoreID,Extra\n"
                    "b1,2024-01-02 10:00:00+02:00,007,2,p1,19.90,s1,z\nb1,not a date,007,1,p2,5,s1,z\n",
    "clients": "ClientCountry,ClientID,ClientSegment,ClientGender,ClientOptINPhone\nFRA,007,LOYAL,M,1\n",
    "products": "ProductID,Category,FamilyLevel1,FamilyLevel2,Universe\np1,,F1,F2,Men\n",
    "stores": "StoreCountry,StoreID\nFRA,s1\n",
    "stocks": "Quantity,ProductID,StoreCountry\n3,p1,FRA\n",
}


def write(folder, **changed):
    for name, text in (FILES | changed).items():
        (folder / f"{name}.csv").write_text(text)
    return str(folder)


def test_columns_bind_by_name(spark, tmp_path):
    t = load_retail_csv(spark, write(tmp_path))
    a, b = t.transactions.orderBy("ProductID").collect()
    assert (a.ClientID, a.ProductID, a.Quantity, a.BasketID, str(a.SalesNetAmountEuro)) == ("007", "p1", 2, "b1", "19.90")
    assert str(a.SaleTransactionDate) == "2024-01-02 10:00:00" and b.SaleTransactionDate is None
    c = cleaning.clean_clients(t.clients).first()
    assert (c.ClientCountry, c.HasEmail, c.HasPhone, c.HasContact) == ("FRA", 0, 1, 1)
    assert t.stocks.first().Quantity == 3 and t.stores.first().StoreCountry == "FRA"


def test_missing_columns(spark, tmp_path):
    plain = FILES["transactions"].replace("BasketID,", "").replace("b1,", "")
    t = load_retail_csv(spark, write(tmp_path, transactions=plain))
    assert "BasketID" not in t.transactions.columns
    ids = {r.BasketID for r in baskets.basket_ids(t.transactions.filter("ProductID = 'p1'")).collect()}
    assert ids == {"007_2024-01-02 10:00:00_s1"}
    with pytest.raises(ValueError, match="StoreCountry"):
        load_retail_csv(spark, write(tmp_path, stores="StoreID\ns1\n"))


def gz(path, text):
    import gzip
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(gzip.compress(text.encode()))


def test_gzip_files_broken_lines_and_any_set_of_columns(spark, tmp_path):
    from shopsignal.sources import csv_files
    write(tmp_path)
    (tmp_path / "stores.csv").unlink()
    gz(tmp_path / "stores" / "a.csv.gz", 'StoreID,StoreCountry\ns1,FRA\n"s,2","DE ""U"""\nfew\n,\n')
    gz(tmp_path / "stores" / "b.csv.gz", "StoreID,StoreCountry\ns3,ITA,extra\ns4,ESP\n")
    found = csv_files.read_retail(spark, str(tmp_path))
    stores = found.tables.stores
    want = [("s,2", 'DE "U"'), ("s1", "FRA"), ("s4", "ESP"), (None, None)]
    assert sorted(map(tuple, stores.collect()), key=str) == sorted(want, key=str)
    # a scan of one column sees the same rows as one of both
    assert sorted(r[0] or "" for r in stores.select("StoreCountry").collect()) == sorted(c or "" for _, c in want)
    assert stores.count() == 4
    assert {(r.table, r.line) for r in found.broken.collect()} == {("stores", "few"), ("stores", "s3,ITA,extra")}
    # written and read again, quotes and commas and all
    csv_files.write_csv(stores, str(tmp_path / "out"), "stores", rows_per_file=1)
    again = csv_files.read_csv(spark, str(tmp_path / "out"), "stores", csv_files.INPUTS["stores"]).rows
    assert sorted(map(tuple, again.collect()), key=str) == sorted(want, key=str)


def test_missing_tables_and_headers_that_differ(spark, tmp_path):
    from shopsignal.sources import csv_files
    empty = csv_files.read_precomputed(spark, str(tmp_path), {"country_trending": "StoreCountry string, FinalScore double"})["country_trending"]
    assert empty.count() == 0 and empty.columns == ["StoreCountry", "FinalScore"]
    with pytest.raises(FileNotFoundError, match="persona"):
        csv_files.read_precomputed(spark, str(tmp_path), {"persona": "ClientID string"})
    gz(tmp_path / "stores" / "a.csv.gz", "StoreID,StoreCountry\ns1,FRA\n")
    gz(tmp_path / "stores" / "b.csv.gz", "StoreCountry,StoreID\nFRA,s1\n")
    with pytest.raises(Exception, match="(?i)header"):
        csv_files.read_csv(spark, str(tmp_path), "stores", csv_files.INPUTS["stores"]).rows.collect()
