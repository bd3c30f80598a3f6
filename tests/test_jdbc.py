"""Databases, by the Derby that Spark brings along."""

import pytest

import sparkrel as s
from sparkrel import types as T
from sparkrel.sources.catalog import Jdbc

people = s.Table("PEOPLE", {"ID": s.Col(T.bigint()).primary_key(), "NAME": s.Col(T.varchar(10)).not_null(), "AGE": s.Col(T.integer()).default(7)}, schema="APP")


@pytest.fixture
def db(spark, tmp_path):
    url = f"jdbc:derby:memory:{tmp_path.name};create=true"
    driver = "org.apache.derby.jdbc.EmbeddedDriver"
    spark._jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(driver)
    con = spark._jvm.java.sql.DriverManager.getConnection(url)
    con.createStatement().execute('CREATE TABLE "APP"."PEOPLE" (ID BIGINT PRIMARY KEY, NAME VARCHAR(10) NOT NULL, AGE INT, NOTE VARCHAR(9) DEFAULT \'fresh\')')
    con.close()
    return s.Engine(spark, Jdbc(url, {"driver": driver}, {"PEOPLE": ("ID", 0, 10, 2)}), [people])


def test_rows_are_appended_and_read_back(db, spark):
    db.insert(people).values([{"ID": 1, "NAME": "ann", "AGE": 30}, {"ID": 2, "NAME": "bob"}]).execute()
    db.insert(people).values(spark.createDataFrame([(3, "cy")], "ID long, NAME string")).execute()
    rows = db.from_(people).select().order_by(s.asc(people.ID)).collect()
    assert rows == [{"ID": 1, "NAME": "ann", "AGE": 30}, {"ID": 2, "NAME": "bob", "AGE": 7}, {"ID": 3, "NAME": "cy", "AGE": 7}]
    assert db.from_(people).select({"n": s.count("*")}).where(s.gt(people.AGE, 7)).collect() == [{"n": 1}]


def test_what_jdbc_cannot_do(db):
    ins = db.insert(people).values({"ID": 1, "NAME": "ann"})
    for bad in (ins.returning(), ins.on_conflict("ID").do_nothing(), db.update(people).set({"AGE": 1}), db.delete(people), db.insert(people).values([{"ID": 1, "NAME": "x"}, {"NAME": "y"}])):
        with pytest.raises(s.QueryError):
            bad.execute()
    ins.execute()
    with pytest.raises(Exception, match="(?i)duplicate"):
        db.insert(people).values({"ID": 1, "NAME": "bob"}).execute()
    assert db.shortcuts.count(people) == 1
