"""List readers, page readers and the monitoring pass on inline fixtures."""

from pyspark.sql import functions as F

from sievework.operators import grouping
from sievework.sources import lists, pages
from sievework.sources.markup import RECORD
from sievework.streaming import monitor

UN = """<LIST dateGenerated="2024-01-01"><INDIVIDUAL><DATAID>7</DATAID><FIRST_NAME>Ann</FIRST_NAME><SECOND_NAME> B &amp; C </SECOND_NAME><REFERENCE_NUMBER>QD.1</REFERENCE_NUMBER>
<INDIVIDUAL_ALIAS><ALIAS_NAME>Annie</ALIAS_NAME></INDIVIDUAL_ALIAS><INDIVIDUAL_DATE_OF_BIRTH><YEAR>1970</YEAR></INDIVIDUAL_DATE_OF_BIRTH>
<INDIVIDUAL_DATE_OF_BIRTH><FROM_YEAR>1960</FROM_YEAR><TO_YEAR>1962</TO_YEAR></INDIVIDUAL_DATE_OF_BIRTH><NATIONALITY><VALUE>X</VALUE><VALUE>Y</VALUE></NATIONALITY></INDIVIDUAL>
<ENTITY><DATAID>9</DATAID><FIRST_NAME>Firm</FIRST_NAME></ENTITY></LIST>"""
UK = """<Designations><Designation><UniqueID>UK1</UniqueID><Names><Name><Name1>Jo</Name1><Name6>Doe</Name6><NameType>Alias</NameType></Name>
<Name><Name1>Joan</Name1><Name6>Doe</Name6><NameType>Primary Name</NameType></Name></Names><DOBs><DOB>dd/mm/1960</DOB></DOBs><OtherInformation>text</OtherInformation></Designation>
<Designation><UniqueID>UK2</UniqueID></Designation></Designations>"""
BOOK = "intro ZONE: North FIR No 12/2019 Name of Accused: Ali Khan alias Jani @ J\nFather's Name: Omar\nCNIC: 35202-1234567-1 DOB: 1980\n ZONE South FIR 9/20\nName of Accused : Zed\nS/O Moe\n"


def one(spark, text):
    return spark.createDataFrame([(text,)], "text string")


def test_xml_lists(spark):
    un = {r["id"]: r for r in lists.consolidated_xml(one(spark, UN)).collect()}
    assert un["QD.1"]["primary_name"] == "Ann B & C" and un["QD.1"]["names"] == ["Ann B & C", "Annie"] and un["QD.1"]["dob"] == "1970; 1960-1962" and un["QD.1"]["nationality"] == "X; Y"
    assert un["9"]["type"] == "Entity"
    uk = lists.designation_xml(one(spark, UK)).collect()
    assert [(r["id"], r["primary_name"], r["names"], r["remarks"]) for r in uk] == [("UK1", "Joan Doe", ["Jo Doe", "Joan Doe"], "text")]
    assert lists.consolidated_xml(one(spark, None)).count() == 0 and lists.designation_xml(one(spark, "")).count() == 0


def test_two_part_csv(spark, tmp_path):
    (tmp_path / "p.csv").write_text('12,"DOE, ""J""",individual,X,-0-,-0-,-0-,-0-,-0-,-0-,-0-,"DOB 1 Jan 1970; nationality Iran; DOB 1971"\n13,-0- ,,,,,,,,,,\n14,SHIP,-0-,Y,,,,,,,,-0-\n')
    (tmp_path / "a.csv").write_text("12,2,aka,SECOND,-0-\n12,1,aka,FIRST,-0-\n12,3,aka,-0-,-0-\n")
    got = {r["id"]: r for r in lists.read_two_part_csv(spark, str(tmp_path / "p.csv"), str(tmp_path / "a.csv")).collect()}
    assert set(got) == {"OFAC-12", "OFAC-14"} and got["OFAC-12"]["names"] == ['DOE, "J"', "FIRST", "SECOND"]
    assert (got["OFAC-12"]["dob"], got["OFAC-12"]["nationality"], got["OFAC-12"]["type"], got["OFAC-14"]["type"]) == ("1 Jan 1970; 1971", "Iran", "Individual", "Entity")
    assert tuple(lists.read_two_part_csv(spark, str(tmp_path / "p.csv"), str(tmp_path / "a.csv")).columns) == RECORD


def test_uploads_of_any_header(spark, tmp_path):
    (tmp_path / "u.csv").write_text("Sr. No;Name of Person;Father's Name;CNIC No.;Province\n5;Ali alias Jan;Omar;35202-1234567-1;KPK\n6;N/A;;;\n")
    got = lists.upload_rows(lists.read_upload(spark, str(tmp_path / "u.csv")), "NACTA schedule", "nacta").collect()
    assert [(r["id"], r["names"], r["father"], r["cnic"], r["province"]) for r in got] == [("NACTA-5", ["Ali", "Jan"], "Omar", "3520212345671", "Khyber Pakhtunkhwa")]
    (tmp_path / "u.json").write_text('{"data": [{"name": "Zed", "designation": "Federal Secretary"}, {"name": "-"}]}')
    got = lists.upload_rows(lists.read_upload(spark, str(tmp_path / "u.json")), "PEP admin upload", "pep", pep=True).collect()
    assert [(r["primary_name"], r["pep_level"]) for r in got] == [("Zed", "National")]
    (tmp_path / "u.xml").write_text("<r><p><Name>Kim</Name></p><p><Name>Lee</Name></p></r>")
    got = lists.upload_rows(lists.read_upload(spark, str(tmp_path / "u.xml")), "x", "nacta").collect()
    assert sorted(r["primary_name"] for r in got) == ["Kim", "Lee"]


def test_red_book_and_news(spark):
    got = lists.red_book(spark.createDataFrame([("Edition", BOOK), ("Empty", "")], "title string, text string")).collect()
    assert [(r["id"], r["names"], r["father"], r["cnic"], r["remarks"]) for r in got] == [
        ("FIA-RB-35202-1234567-1", ["Ali Khan", "Jani", "J"], "Omar", "3520212345671", "Zone: North; FIR: 12/2019"), ("FIA-RB-2", ["Zed"], "Moe", "", "Zone: South; FIR: 9/20"),
    ]
    feed = "<rss><item><title>A &amp; B</title><description>&amp;lt;b&amp;gt;hi&amp;lt;/b&amp;gt;</description><source url='x'>S</source></item></rss>"
    row = lists.news_items(spark.createDataFrame([(1, feed)], "applicant_id long, text string")).first()
    assert (row["title"], row["description"], row["source"]) == ("A & B", "hi", "S")


def test_pages(spark):
    html = """<table><tr><th>No</th><th>Name</th><th>Constituency</th></tr><tr><td rowspan=2>1</td><td>Dr Ann [1] (late)</td><td>NA-1</td></tr><tr><td>Robert</td><td>NA-2</td></tr>
    <tr><td>3</td><td>Vacant</td><td>NA-3</td></tr><tr><td>4</td><td>robert</td><td>NA-4</td></tr></table>"""
    df = spark.createDataFrame([("u", html), ("v", None)], "url string, text string")
    assert sorted((r["name"], r["seat"]) for r in pages.table_members(df).collect()) == [("Dr Ann", "NA-1"), ("Robert", "NA-2")]
    pairs = spark.createDataFrame([("u", "<p>Ann Lee | Party</p><p>PP-12 Town</p><script>x</script><b>Boris Ek</b> <i>PP-13</i>")], "url string, text string")
    assert sorted((r["name"], r["seat"]) for r in pages.seat_pairs(pairs).collect()) == [("Ann Lee", "PP-12"), ("Boris Ek", "PP-13")]
    links = spark.createDataFrame([("u", '<a href="/x/book.pdf">Red Book 2</a><a href="http://evil.org/b.pdf">Red Book</a><a class="c" href="/members/9">Ann Lee PB-3 Place</a>')], "url string, text string")
    assert [tuple(r) for r in pages.editions(links, "example.org").collect()] == [("https://example.org/x/book.pdf", "Red Book 2")]
    assert [(r["name"], r["seat"]) for r in pages.card_members(links).collect()] == [("Ann Lee", "PB-3")]
    counts = spark.createDataFrame([("a", 97, "Showing 1 - 20 of 100"), ("b", 3, "")], "key string, read int, text string")
    assert {r["key"]: r["ok"] for r in pages.complete(counts).collect()} == {"a": False, "b": True}


def test_person_groups_are_complete_links(spark):
    rows = [
        (1, 1, 95.0, "Ali Raza Khan", None, [], "", "Punjab", "1970"), (1, 2, 90.0, "Raza Ali Khan", None, [], "", "Pb.", None), (1, 3, 90.0, "Ali Raza Khan", None, [], "", "Sindh", None),
        (1, 4, 80.0, "Other Man", None, ["Ali Raza Khan"], "", "Punjab", "1971"), (2, 5, 70.0, "Solo", None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "applicant_id long, match_id long, score double, primary_name string, matched_name string, aliases array<string>, cnic string, province string, dob string")
    assert {r["match_id"]: (r["person_no"], r["is_lead"]) for r in grouping.person_groups(df).collect()} == {1: (1, True), 2: (1, False), 3: (2, True), 4: (3, True), 5: (1, True)}


def test_monitoring_pass_repeats_without_new_alerts(spark, tmp_path):
    now = spark.createDataFrame([("a", "1", True), ("b", "2", True), ("c", None, False), ("d", "4", True)], "source string, fingerprint string, available boolean")
    before = spark.createDataFrame([("a", "1"), ("b", "9"), ("c", "3")], "source string, fingerprint string")
    assert {r["source"]: r["status"] for r in monitor.change_status(now, before).collect()} == {"a": "unchanged", "b": "changed", "c": "unavailable", "d": "first_seen"}
    assert {r["source"]: r["fingerprint"] for r in monitor.next_state(now, before).collect()} == {"a": "1", "b": "2", "c": "3", "d": "4"}
    schema = "applicant_id long, source string, list string, ref string"
    found = spark.createDataFrame([(1, "S", "L", "x"), (1, "S", "L", "y"), (1, "S", "L", "y"), (2, "S", "L", "x")], schema)
    base, none = spark.createDataFrame([(1, "S", "L", "x")], schema), spark.createDataFrame([], schema)
    alerts = monitor.new_alerts(found, base, none)
    assert alerts.count() == 2 and monitor.new_alerts(found, base, alerts).count() == 0


def test_streams_give_the_batch_result(spark, tmp_path):
    rows = spark.range(200).select(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 997).alias("ts"), F.concat(F.lit("k"), (F.col("id") % 3).cast("string")).alias("kind"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    monitor.run_once(stream, lambda df, i: df.write.mode("append").parquet(out), str(tmp_path / "ck"))
    monitor.run_once(stream, lambda df, i: df.write.mode("append").parquet(out), str(tmp_path / "ck"))
    assert spark.read.parquet(out).count() == 200
    q = monitor.windowed_counts(stream, "ts", "kind", "1 hour").writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = monitor.windowed_counts(rows, "ts", "kind", "1 hour")
    assert spark.table("w").exceptAll(batch).count() == 0 and spark.table("w").count() == batch.count()


def _zip(path, parts):
    import zipfile

    with zipfile.ZipFile(path, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)


def test_applicant_files(spark, tmp_path):
    from sievework.sources import applicants

    (tmp_path / "a.csv").write_bytes("Report\nName of Applicant;CNIC;Note\nJosé;35202-1234567-1;x\n;;\nحسن;;\n".encode("cp1256", "replace"))
    _zip(tmp_path / "b.xlsx", {
        "xl/sharedStrings.xml": "<sst><si><t>Full Name</t></si><si><t>Ann Lee</t></si></sst>",
        "xl/worksheets/sheet1.xml": '<worksheet><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>CNIC</t></is></c></row>'
        '<row r="4"><c r="A4" t="s"><v>1</v></c><c r="C4"><v>3520212345671.0</v></c></row></sheetData></worksheet>',
    })
    _zip(tmp_path / "c.docx", {"word/document.xml": "<d><tbl><tr><tc><p><t>Applicant</t></p></tc><tc><t>Province</t></tc></tr><tr><tc><t>Bo</t></tc><tc><t>KPK</t></tc></tr></tbl></d>"})
    rows = applicants.read_applicants(spark, str(tmp_path))
    got = {r["path"].rsplit("/", 1)[-1]: (r["row_no"], r["full_name"], r["cnic"], r["province"]) for r in rows.filter("path NOT LIKE '%csv'").collect()}
    assert got == {"b.xlsx": (4, "Ann Lee", "3520212345671", None), "c.docx": (2, "Bo", None, "KPK")}
    assert [r["row_no"] for r in rows.filter("path LIKE '%csv'").collect()] == [3, 5]
    names = spark.createDataFrame([(1, "Ann"), (2, None), (3, "x" * 300), (4, "Анна"), (5, "--")], "row_no int, full_name string")
    assert {r["row_no"]: r["state"] for r in applicants.prepared(names).collect()} == {1: "pending", 2: "invalid", 3: "invalid", 4: "invalid", 5: "invalid"}


def test_snapshot_of_officials(spark):
    from sievework.sources import officials

    people = [
        ("1", "Ann Lee", ["A. Lee", "Ann Lee"], "1970-01-02T00:00:00Z", None, [("Senator", "2001", "2003-05-05"), ("Governor of Sindh", "2023", None), ("Dentist", None, None)]),
        ("2", "Bo Ek", [], None, "2020-01-01", [("Senator", None, None)]), ("3", "Cy Old", [], None, None, [("Senator", "1990", "1995-01-01")]),
    ]
    pols = [("4", "Lee Ann", None, "P"), ("5", "Dee Poe", "1980", "P")]
    mems = [("na", "House", "National", "", "url", "Dee Poe", None, "NA-1", ""), ("na", "House", "National", "", "url", "Eve Fay", None, "NA-2", "Q")]
    got = officials.snapshot_records(spark.createDataFrame(people, officials.PEOPLE), spark.createDataFrame(pols, officials.POLITICIANS), spark.createDataFrame(mems, officials.MEMBERS), "2024-01-01", 5)
    rows = {r["id"]: r for r in got.collect()}
    assert set(rows) == {"PEP-WD-1", "PEP-WD-5", "PEP-ASM-na-EveFay"}
    assert (rows["PEP-WD-1"]["pep_level"], rows["PEP-WD-1"]["province"], rows["PEP-WD-1"]["position"], rows["PEP-WD-1"]["names"]) == ("Provincial", "Sindh", "Governor of Sindh (from 2023)", ["Ann Lee", "A. Lee"])
    assert rows["PEP-ASM-na-EveFay"]["position"] == "Member, House (NA-2, Q)" and rows["PEP-WD-5"]["pep_level"] == "Political"


def test_functions_in_sql(spark):
    from sievework.functions.register import register

    assert "name_score" in register(spark)
    row = spark.sql("SELECT name_score('Mohammed Ali', 'Muhammad Ali') s, name_reason('M Ali', 'Muhammad Ali') r, name_tokens('Dr Mohd') t").first()
    assert (row["s"], row["r"], row["t"]) == (100.0, "initials", ["MUHAMAD"])


def test_cells_keep_words_apart_and_leave_notes_out():
    page = "<table><tr><th rowspan=2>Name<th colspan=2>Seat</tr><tr><td>a<td>b</tr><tr><td>Ann<br>Lee<sup>a</sup><td>NA-1<script>x()</script><td><table><tr><td>in</td></tr></table></table>"
    assert pages.table_rows(page) == [(0, 0, ["in"]), (1, 0, ["Name", "Seat", "Seat"]), (1, 1, ["Name", "a", "b"]), (1, 2, ["Ann Lee", "NA-1", ""])]
    assert pages.table_rows("") == [] and pages.table_rows(None) == [] and pages.table_rows("<table><tr><td>open") == [(0, 0, ["open"])]
