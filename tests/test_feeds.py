"""Feeds of the layouts of FIXTURES.md, with odd cells, absent columns and empty files."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidewater.sources import feeds, files

D = dt.date


def written(tmp_path, name, text):
    (tmp_path / name).write_text(text, encoding="utf-8")
    return str(tmp_path / name)


def test_price_day(spark, tmp_path):
    head = "﻿TradDt,Src,ISIN,TckrSymb,SctySrs,OpnPric,HghPric,LwPric,ClsPric,PrvsClsgPric,TtlTradgVol,TtlTrfVal,TtlNbOfTxsExctd,Rsvd1"
    rows = ["2024-01-05,NSE,INE1, ABC ,EQ,10,12,9,11,10,\"1,000\",11000,5,x", "2024-01-05,NSE,INE1,ABC,EQ,10,8,9,11,10,5,55,1,", "bad,NSE,,X,EQ,,,,0,,0,,,"]
    got = feeds.read_layout(spark, written(tmp_path, "p.csv", "\n".join([head, *rows])), feeds.PRICE_DAY)
    first = got.where("volume = 1000").first()
    assert (first.day, first.symbol, first.close) == (D(2024, 1, 5), "ABC", 11.0)
    assert feeds.price_day_checks(got).first().asDict() == {"rows": 3, "no_day": 1, "no_security": 1, "no_close": 0, "not_positive": 1, "bad_range": 1, "repeated": 1}
    empty = feeds.read_layout(spark, written(tmp_path, "e.csv", head), feeds.PRICE_DAY)
    assert feeds.price_day_checks(empty).first().rows == 0
    with pytest.raises(ValueError, match="TradDt"):
        feeds.read_layout(spark, written(tmp_path, "q.csv", "a,b\n1,2"), feeds.PRICE_DAY)


def test_market_caps_and_index_closes(spark, tmp_path):
    caps = written(tmp_path, "m.csv", "TRADE DATE ,Symbol,Series,Category,Issue Size,Close Price/Paid up value(Rs.),Market Cap(Rs.)\n05 Jan 2024,ABC,EQ,Listed,\"1,000\",10,10000\n05 Jan 2024,X,EQ,Listed,1000,10,99999\n05 Jan 2024,Y,EQ,Permitted,,10,7")
    got = feeds.read_layout(spark, caps, feeds.MARKET_CAP)
    assert feeds.market_cap_checks(got).first().asDict() == {"rows": 3, "no_day": 0, "no_issue_size": 1, "off": 2}
    closes = feeds.read_layout(spark, written(tmp_path, "i.csv", "Index Name,Index Date,Closing Index Value,P/E\nNifty 500,05-01-2024,20000.5,-"), feeds.INDEX_CLOSE)
    assert [tuple(r) for r in closes.collect()] == [("Nifty 500", D(2024, 1, 5), 20000.5, None, None, None)]


def test_deals_and_bands(spark, tmp_path):
    deals = written(tmp_path, "d.csv", "Date ,Symbol,Security Name,Client Name,Buy / Sell,Quantity Traded,Trade Price / Wght. Avg. Price,Remarks\n05-JAN-2024,ABC,Abc Ltd,A CLIENT,BUY,\"12,500\",10.5,-")
    got = feeds.read_layout(spark, deals, feeds.BULK_DEALS).first()
    assert (got.day, got.client, got.side, got.quantity, got.price) == (D(2024, 1, 5), "A CLIENT", "BUY", 12500.0, 10.5)
    assert feeds.read_layout(spark, written(tmp_path, "b.csv", "Symbol,Series,Band\nABC,EQ,20"), feeds.BAND_LIST).first().band == "20"


def test_actions_state_their_terms(spark, tmp_path):
    subjects = ["Bonus 1:3", "Face Value Split (Sub-Division) - From Rs 10/- Per Share To Re 1/- Per Share", "Dividend - Rs 2.50 Per Share/ Special Dividend Re 1 Per Sh", "Rights 2:15 @ Premium Rs 90", "Buy Back", "Scheme Of Amalgamation", "Interest Payment", None, "Scheme Of Arrangement - Bonus 1:1", "De-merger", "Spin Off", "Capital Reduction", "Right Issue 1:2"]
    rows = [{"symbol": "A", "isin": "I", "subject": s, "exDate": "05-Jan-2024", "recDate": "-", "faceVal": "10"} for s in subjects]
    path = written(tmp_path, "a.json", json.dumps(rows))
    got = feeds.action_terms(files.json_rows(spark, path, feeds.ACTION_FIELDS)).collect()
    assert [(r.purpose, r.new_for, r.held, r.face_from, r.face_to, r.dividend) for r in got] == [
        ("bonus", 1, 3, None, None, None), ("split", None, None, 10, 1, None), ("dividend", None, None, None, None, 3.5), ("rights", 2, 15, None, None, None),
        ("buyback", None, None, None, None, None), ("scheme", None, None, None, None, None), ("other", None, None, None, None, None), ("other", None, None, None, None, None),
        ("bonus", 1, 1, None, None, None), ("demerger", None, None, None, None, None), ("demerger", None, None, None, None, None), ("capital_reduction", None, None, None, None, None), ("rights", 1, 2, None, None, None),
    ]
    assert got[0].ex_day == D(2024, 1, 5) and got[0].record_day is None


def test_stakes_flows_and_meetings(spark, tmp_path):
    stake = {"symbol": "A", "acquirerName": "H", "acqType": " Equity shares ", "promoterType": "No", "noOfShareAcq": "1,000", "totAcqShare": "5.79", "totAftShare": "6.1", "timestamp": "05-Jan-2024 10:30"}
    got = feeds.stake_terms(files.json_rows(spark, written(tmp_path, "s.json", json.dumps({"data": [stake, {}]})), f"data array<struct<{', '.join(c.replace(' ', ': ') for c in feeds.STAKE_FIELDS.split(', '))}>>", "data")).collect()
    assert (got[0].instrument, got[0].is_promoter, got[0].shares_bought, got[0].pct_bought, got[0].pct_sold, got[0].seen) == ("Equity shares", False, 1000.0, 5.79, None, dt.datetime(2024, 1, 5, 10, 30)) and got[1].holder is None
    flows = spark.createDataFrame([("FII", "05-Jan-2024", "1,000.5", "400", "(600.5)"), ("DII", "05-Jan-2024", "10", "4", "6"), ("X", None, None, "4", "6")], feeds.FLOW_FIELDS)
    assert [r.adds_up for r in feeds.flow_terms(flows).collect()] == [False, True, None]
    text = spark.createDataFrame([("Audited Financial Results and Dividend",), ("Fund Raising by QIP",), (None,)], "t string")
    assert [[k for k, v in r.asDict().items() if v] for r in text.select(*feeds.meeting_flags(F.col("t"))).collect()] == [["results", "dividend"], ["fund_raising"], []]
