"""The engine's input tables as views over the star-schema, document and page tables."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from letterloom.sources.tables import read_table, spread

LEXICON = [
    "the", "der", "que", "thin", "leverage", "delve", "utilize", "innovative", "dynamic", "impactful",
]
WORD_PAIRS = [("le", "la"), ("the", "this"), ("der", "die")]


class Tables:
    """Lazy views of one data folder. Nothing but table schemas is read before a query runs."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self.tables: dict[str, DataFrame] = {}

    def read(self, name: str) -> DataFrame:
        if name not in self.tables:
            self.tables[name] = read_table(self.spark, f"{self.folder}/{name}.parquet")
        return self.tables[name]

    def spread_out(self, name: str, keys: list[str], columns: list[str]) -> DataFrame:
        """A table that is heavy to work on per row."""
        return spread(self.read(name).select(*columns), *keys)

    def size(self, name: str) -> Column:
        """The number of rows of a table, as a scalar subquery."""
        return self.read(name).agg(F.count(F.lit(1))).scalar()

    def documents(self) -> DataFrame:
        return self.spread_out("documents", ["doc_id"], ["doc_id", "source", "text"])

    def pages(self) -> DataFrame:
        return self.spread_out("pages", ["page_id"], ["page_id", "url", "html"])

    def samples(self) -> DataFrame:
        kind = F.when(F.col("doc_id") % 3 == 0, "resume").otherwise("cover_letter")
        return self.documents().select(
            F.col("source").alias("author_id"), kind.alias("kind"), "doc_id", "text"
        )

    def sample_files(self) -> DataFrame:
        """Samples with a file name; every 13th one is hidden."""
        hidden = F.when(F.col("doc_id") % 13 == 0, ".").otherwise("")
        doc = F.lpad(F.col("doc_id").cast("string"), 9, "0")
        return self.samples().withColumn(
            "file_name", F.concat(hidden, "author_id", F.lit("_"), doc, F.lit(".md"))
        )

    def fetched(self) -> DataFrame:
        body = F.when(F.col("page_id") % 23 == 0, "  short  ").otherwise(F.col("html"))
        return self.pages().select(
            "page_id",
            "url",
            F.when(F.col("page_id") % 17 == 0, 404).otherwise(200).alias("status"),
            body.alias("body"),
        )

    def requests(self) -> DataFrame:
        """Requested sources in every form: both schemes, other case, ports, file names."""
        page = F.col("page_id")
        source = (
            F.when(page % 7 == 0, F.concat(F.lit("job_"), page.cast("string"), F.lit(".txt")))
            .when(page % 7 == 1, F.replace("url", F.lit("http"), F.lit("HTTP")))
            .when(page % 7 == 2, F.regexp_replace("url", "^(https?://)([^/]*)", "$1www.$2:8443"))
            .when(page % 7 == 3, F.concat("url", F.lit("/Stellen angebote/für Ä")))
            .when(page % 7 == 4, F.concat(F.regexp_replace("url", "[?#].*$", ""), F.repeat(F.lit("/long-path"), 10)))
            .otherwise(F.col("url"))
        )
        return self.read("pages").select("page_id", source.alias("source"))

    def skill_mentions(self) -> DataFrame:
        """Every skill that a document of a person names, with repeats."""
        orders = self.read("orders").select("o_orderkey", "o_custkey")
        items = self.read("lineitem").select("l_orderkey", "l_partkey")
        part = self.read("part").select("p_partkey", "p_name")
        return (
            items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(part, F.col("l_partkey") == F.col("p_partkey"))
            .select(F.col("o_custkey").alias("applicant_id"), F.col("p_name").alias("skill"))
        )

    def skills(self) -> DataFrame:
        return self.skill_mentions().distinct()

    def requirements(self) -> DataFrame:
        """All skills of each posting; the eight asked for most often are required, the rest preferred."""
        items = self.read("lineitem").select("l_suppkey", "l_partkey")
        part = self.read("part").select("p_partkey", "p_name")
        asked = (
            items.join(part, F.col("l_partkey") == F.col("p_partkey"))
            .groupBy(F.col("l_suppkey").alias("job_id"), F.col("p_name").alias("skill"))
            .agg(F.count(F.lit(1)).alias("n"))
        )
        # every skill of a posting, at most one row a term of the vocabulary
        often_first = Window.partitionBy("job_id").orderBy(F.col("n").desc(), F.col("skill").asc())
        return asked.withColumn("rnk", F.row_number().over(often_first)).select(
            "job_id",
            "skill",
            "rnk",
            F.when(F.col("rnk") <= 8, "required").otherwise("preferred").alias("level"),
        )

    def listed_requirements(self) -> DataFrame:
        """Requirements as written: the last two required skills are listed as preferred again."""
        asked = self.requirements().select("job_id", "skill", "rnk", "level")
        again = asked.filter(F.col("rnk").between(7, 8)).withColumn("level", F.lit("preferred"))
        return asked.unionByName(again)

    def applications(self) -> DataFrame:
        orders = self.read("orders").select("o_orderkey", "o_custkey")
        items = self.read("lineitem").select("l_orderkey", "l_suppkey")
        customer = self.read("customer").select("c_custkey", "c_nationkey")
        supplier = self.read("supplier").select("s_suppkey", "s_nationkey")
        homes = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        return (
            items.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
            .join(
                homes,
                (F.col("l_orderkey") == F.col("o_orderkey"))
                & (F.col("c_nationkey") == F.col("s_nationkey")),
            )
            .select(F.col("o_custkey").alias("applicant_id"), F.col("l_suppkey").alias("job_id"))
            .distinct()
        )

    def roles(self) -> DataFrame:
        start = 12 * F.year("o_orderdate") + F.month("o_orderdate")
        return self.read("orders").select(
            F.col("o_custkey").alias("applicant_id"),
            F.col("o_orderkey").alias("role_id"),
            F.col("o_orderpriority").alias("title"),
            F.col("o_orderstatus").alias("company"),
            start.alias("start_m"),
            (start + (F.col("o_orderkey") % 24).cast("int")).alias("end_m"),
            (F.col("o_orderkey") % 11 == 0).alias("is_current"),
        )

    def bullets(self) -> DataFrame:
        amount = F.col("l_quantity").cast("int").cast("string")
        text = F.when(
            F.col("l_quantity") >= 25,
            F.concat(F.lit("Delivered "), amount, F.lit(" units of "), "p_name"),
        ).otherwise(F.concat(F.lit("responsible for "), "p_name"))
        items = self.spread_out(
            "lineitem",
            ["l_orderkey", "l_partkey"],
            ["l_orderkey", "l_linenumber", "l_quantity", "l_partkey"],
        )
        part = self.read("part").select("p_partkey", "p_name")
        return items.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
            F.col("l_orderkey").alias("role_id"),
            F.col("l_linenumber").alias("bullet_no"),
            text.alias("text"),
        )

    def role_mentions(self) -> DataFrame:
        """Every past role as one to three resumes tell it, later ones with another title, another form
        of the company's name, a start in whole years, or no start at all."""
        role, version = F.col("role_id"), F.col("version")
        told = self.roles().withColumn("version", F.explode(F.sequence(F.lit(0), (F.col("role_id") % 3).cast("int"))))
        company = (
            F.when(version == 0, F.concat(F.lit("Works "), "company"))
            .when(version == 1, F.concat(F.lit("works "), "company", F.lit(" GmbH")))
            .otherwise(F.concat(F.lit("WORKS "), "company", F.lit(", Inc.")))
        )
        january = (F.col("start_m") - 1) - (F.col("start_m") - 1) % 12 + 1
        start = (
            F.when(version == 0, F.col("start_m"))
            .when(version == 1, january)
            .when(role % 5 > 0, F.col("start_m") + 1)
        )
        return told.select(
            "applicant_id",
            (role * 3 + version).alias("mention_id"),
            "role_id",
            "version",
            F.when(version == 1, F.concat(F.lit("Senior "), "title")).otherwise(F.col("title")).alias("title"),
            company.alias("company"),
            F.when(version == 2, "").otherwise(F.concat(F.lit("Hall "), (role % 4).cast("string"))).alias("location"),
            start.cast("int").alias("start_m"),
            F.when(~F.col("is_current"), F.col("end_m")).alias("end_m"),
        )

    def mention_bullets(self) -> DataFrame:
        """The bullets of a role as its mentions have them: the last one says more."""
        longer = F.when(F.col("version") == 2, F.concat("text", F.lit(" on time"))).otherwise(F.col("text"))
        held = (F.col("bullet_no") + F.col("version")) % 3 < 2
        told = self.role_mentions().select("role_id", "version", "mention_id")
        return self.bullets().join(told, "role_id").filter(held).select("mention_id", longer.alias("text"))

    def facts(self) -> DataFrame:
        return self.read("events").select(
            F.col("user_id").alias("applicant_id"),
            F.col("event_type").alias("field"),
            "value",
            "ts",
            "event_id",
        )

    def outputs(self) -> DataFrame:
        turns = self.spread_out(
            "conversations", ["conv_id", "turn"], ["conv_id", "turn", "role", "text"]
        )
        return (
            turns.filter(F.col("role") == "assistant")
            .select(F.col("conv_id").alias("application_id"), "turn", "text")
        )

    def outputs_num(self) -> DataFrame:
        shown = F.col("l_quantity").cast("int") + F.when(F.col("l_orderkey") % 7 == 0, 1).otherwise(0)
        return self.read("lineitem").select(
            F.col("l_orderkey").alias("role_id"),
            F.col("l_linenumber").alias("bullet_no"),
            F.concat(F.lit("Delivered "), shown.cast("string"), F.lit(" units")).alias("text"),
        )

    def vocabulary(self) -> DataFrame:
        return self.read("part").select(F.col("p_name").alias("skill")).distinct()

    def related(self) -> DataFrame:
        """The topic of every skill is its noun."""
        return self.vocabulary().withColumn("topic", F.split_part("skill", F.lit(" "), F.lit(2)))

    def covers(self) -> DataFrame:
        """A skill covers those of its noun that come after it by name, and those of the next noun that
        begin like it; so no pair is covered both ways."""
        words = self.vocabulary().select("skill", F.split("skill", " ").alias("w"))
        first = words.select("skill", F.get("w", F.lit(0)).alias("head"), F.get("w", F.lit(1)).alias("noun"))
        other = first.select(F.col("skill").alias("covers"), F.col("head").alias("head2"), F.col("noun").alias("noun2"))
        same_noun = first.join(other, (F.col("noun") == F.col("noun2")) & (F.col("skill") < F.col("covers")))
        same_head = first.join(other, (F.col("head") == F.col("head2")) & (F.col("noun") < F.col("noun2")))
        return same_noun.unionByName(same_head).select("skill", "covers").distinct()

    def categories(self) -> DataFrame:
        return (
            self.read("part")
            .groupBy(F.col("p_name").alias("skill"))
            .agg(F.min("p_type").alias("category"))
        )

    def claims(self) -> DataFrame:
        value = F.when(
            F.col("applicant_id") % 5 == 0, F.concat("skill", F.lit(" expert"))
        ).otherwise(F.col("skill"))
        return self.skills().select("applicant_id", F.lit("skill").alias("kind"), value.alias("value"))

    def style_cache(self) -> DataFrame:
        return (
            self.read("documents")
            .filter(F.col("source") < "src2")
            .select(F.col("source").alias("author_id"))
            .distinct()
        )

    def postings(self) -> DataFrame:
        """Postings rendered as text from the suppliers and their requirements."""
        s = F.col("s_suppkey")
        number = s.cast("string")
        place = (
            F.when(s % 4 == 0, " (Remote)")
            .when(s % 4 == 1, " (Hybrid, 2 days)")
            .when(s % 4 == 2, " (On-site)")
            .otherwise("")
        )
        salary = F.when(s % 5 == 0, "").otherwise(
            F.concat(
                F.lit("Salary: $"),
                (50000 + s * 10).cast("string"),
                F.lit(" - $"),
                (70000 + s * 10).cast("string"),
                F.lit("\n"),
            )
        )
        manager = F.when(
            s % 2 == 0, F.concat(F.lit("Hiring manager: Manager "), number, F.lit("\n"))
        ).otherwise("")

        def listed(chosen: Column) -> Column:
            lines = F.transform(chosen, lambda a: F.concat(F.lit("- "), a["skill"]))
            return F.array_join(lines, "\n")

        # at most one entry a term of the vocabulary
        asked = self.requirements().groupBy("job_id").agg(
            F.array_sort(F.collect_list(F.struct("rnk", "skill"))).alias("asked")
        )
        text = F.concat(
            F.lit("Title: "),
            F.when(s % 3 == 0, "Senior ").otherwise(""),
            F.lit("Planner\nCompany: "),
            "s_name",
            F.lit("\nLocation: "),
            "n_name",
            place,
            F.lit("\n"),
            salary,
            manager,
            F.lit("About: we value ownership. Asks for "),
            (2 + s % 7).cast("string"),
            F.lit("+ years.\nResponsibilities:\n- Take ownership of "),
            F.get("asked", F.lit(0))["skill"],
            F.lit("\n- Maintain "),
            F.get("asked", F.lit(1))["skill"],
            F.lit("\nRequired:\n"),
            listed(F.filter("asked", lambda a: a["rnk"] <= 8)),
            F.lit("\nPreferred:\n"),
            listed(F.filter("asked", lambda a: a["rnk"] >= 7)),
            F.lit("\n"),
        )
        nation = self.read("nation").select("n_nationkey", "n_name")
        return (
            self.read("supplier")
            .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
            .join(asked, F.col("job_id") == F.col("s_suppkey"))
            .select("job_id", text.alias("text"))
        )

    def styled_postings(self) -> DataFrame:
        """Postings as people write them: Markdown, numbered lists, dashes, lines that end in two signs."""
        s = F.col("s_suppkey")
        low, high = (50 + s % 40).cast("string"), (70 + s % 40).cast("string")
        title = F.concat(F.when(s % 3 == 0, "Senior ").otherwise(""), F.lit("Planner"))
        asked = self.requirements().groupBy("job_id").agg(
            F.array_sort(F.collect_list(F.struct("rnk", "skill"))).alias("asked")
        )
        required, wished = F.filter("asked", lambda a: a["rnk"] <= 8), F.filter("asked", lambda a: a["rnk"] >= 7)
        top = [F.get("asked", F.lit(i))["skill"] for i in (0, 1)]

        def listed(chosen: Column, before: str, after: str, numbered: bool = False) -> Column:
            def line(a: Column, i: Column) -> Column:
                number = (i + 1).cast("string") if numbered else F.lit("")
                return F.concat(F.lit(before), number, F.lit(after), a["skill"], F.lit("\n"))

            return F.array_join(F.transform(chosen, line), "")

        markdown = F.concat(
            F.lit("# "), title, F.lit("\n"), "s_name", F.lit(" - "), "n_name",
            F.lit("\n\n**About us**\nWe value ownership.\n\n## Responsibilities\n* Take ownership of "), top[0],
            F.lit("\n* Maintain "), top[1], F.lit("\n\n**Requirements**\n"), listed(required, "*", " "),
            F.lit("\n## Nice to have\n"), listed(wished, "* ", ""),
            F.lit("\n**Compensation:** $"), low, F.lit("k-"), high, F.lit("k\nApply soon."),
        )
        numbers = F.concat(
            title, F.lit(" at "), "s_name", F.lit("\nPlace: "), "n_name",
            F.lit("\nWhat you will do:\n1. Take ownership of "), top[0], F.lit("\n2. Maintain "), top[1],
            F.lit("\nRequirements (must):\n"), listed(required, "", ") ", True), F.lit("Bonus\n"),
            listed(wished, "(", ") ", True), F.lit("Benefits:\n- free tea\nWe pay €"), low, F.lit(",000 – €"), high,
            F.lit(",000 a year"),
        )
        dashes = F.concat(
            F.lit("Position: "), title, F.lit("\nEmployer: "), "s_name", F.lit("\nMust-have skills:\n"),
            listed(required, "–", " "), F.lit("Preferred qualifications (plus):\n"), listed(wished, "  — ", ""), F.lit("\n\n"),
        )
        labels = F.concat(
            F.lit("Role: "), title, F.lit("\nOrganisation: "), "s_name", F.lit("\nOffice: "), "n_name",
            F.lit("\nPay range: £"), low, F.lit(",000\nESSENTIAL SKILLS\n"), listed(required, "•", " "),
        )
        text = (
            F.when(s % 4 == 0, markdown).when(s % 4 == 1, numbers).when(s % 4 == 2, dashes)
            .otherwise(F.replace(labels, F.lit("\n"), F.lit("\r\n")))
        )
        nation = self.read("nation").select("n_nationkey", "n_name")
        return (
            self.read("supplier")
            .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
            .join(asked, F.col("job_id") == s)
            .select("job_id", text.alias("text"))
        )

    def letters(self) -> DataFrame:
        """Finished letters: the outputs with a greeting, a company line and a signature, dealt to all
        jobs and people in turn.

        Every third letter names its company, every sixth a detail too; one in four opens with a
        stock phrase, one in five closes with one and one in seven is signed by another name.
        """
        a = F.col("application_id")
        opening = F.when(a % 4 == 0, "I am excited about this role. ").otherwise("")
        company = F.when(a % 3 == 0, F.concat(F.lit("At "), "s_name", F.lit(" I would help. "))).otherwise("")
        detail = F.when(a % 6 == 0, F.concat(F.lit("I can Maintain "), "detail", F.lit("."))).otherwise("")
        closing = F.when(a % 5 == 0, "Thank you for your consideration.").otherwise("Let us talk.")
        signed = F.when(a % 7 == 0, "Someone Else").otherwise(F.col("c_name"))
        sign_off = F.when(a % 8 == 0, "Yours,").otherwise("Best regards,")
        text = F.concat(
            F.lit("Dear Hiring Manager,\n\n"), opening, "text", F.lit("\n\n"), company, detail,
            F.lit("\n\n"), closing, F.lit("\n\n"), sign_off, F.lit("\n"), signed,
        )
        supplier = self.read("supplier").select(F.col("s_suppkey").alias("job_id"), "s_name")
        customer = self.read("customer").select(F.col("c_custkey").alias("applicant_id"), "c_name")
        second = self.requirements().filter(F.col("rnk") == 2).select("job_id", F.col("skill").alias("detail"))
        return (
            self.outputs()
            .withColumn("job_id", a % self.size("supplier"))
            .withColumn("applicant_id", a % self.size("customer"))
            .join(supplier, "job_id")
            .join(second, "job_id")
            .join(customer, "applicant_id")
            .select("application_id", "turn", "job_id", "applicant_id", text.alias("text"))
        )

    def templates(self) -> DataFrame:
        """One template and its variables per part, in six forms."""
        form = F.col("p_partkey") % 6
        text = (
            F.when(form == 0, "Dear {{NAME}}, {{NAME}} knows {{SKILL}}.")
            .when(form == 1, "Spaced {{ NAME }} and {{SKILL}}.")
            .when(form == 2, "Triple {{{NAME}}} and {{SKILL}}.")
            .when(form == 3, F.concat(F.lit("No hole for "), "p_name"))
            .when(form == 4, "Dotted {{a.b}} and {{axb}}.")
            .otherwise("Chained {{OUTER}} then {{NAME}}; never {{LOST}}.")
        )
        name = F.concat(F.lit("$& \\item "), "p_brand")
        variables = F.create_map(
            F.lit("NAME"), name,
            F.lit("{{SKILL}}"), F.col("p_name"),
            F.lit("a.b"), F.lit("dot"),
            F.lit("OUTER"), F.concat(F.lit("[{{NAME}} "), "p_type", F.lit("]")),
        )
        return self.read("part").select(
            F.col("p_partkey").alias("template_id"), text.alias("text"), variables.alias("variables")
        )

    def profile_json(self) -> DataFrame:
        """Profiles as JSON, one in two of them broken in some way."""
        c = F.col("c_custkey")
        form = c % 10
        email = F.concat(F.lit("c"), c.cast("string"), F.lit("@example.com"))
        phone = F.when(form == 7, F.lit(None)).otherwise(F.concat(F.lit("555-"), c.cast("string")))
        record = F.struct(
            F.col("c_name").alias("name"),
            F.when(form != 1, email).alias("email"),
            F.when(c % 3 == 0, phone).alias("phone"),
            F.concat(F.lit("Works in "), "c_mktsegment").alias("summary"),
            F.array(F.lit("Python"), "c_mktsegment").alias("skills"),
            F.array(
                F.struct(
                    F.lit("Planner").alias("title"),
                    F.when(form != 2, "Acme").alias("company"),
                    F.lit("").alias("location"),
                    F.lit("1998-10").alias("start_date"),
                    F.lit("present").alias("end_date"),
                    F.array(F.lit("Delivered 3 units")).alias("bullets"),
                )
            ).alias("experience"),
            F.array(
                F.struct(
                    F.lit("BSc").alias("degree"),
                    F.lit("Some School").alias("school"),
                    (1990 + c % 20).cast("double").alias("graduation_year"),
                )
            ).alias("education"),
            F.when(form == 3, "dropped").alias("hobby"),
        )
        json = F.to_json(record)
        broken = (
            F.when(form == 4, F.replace(json, F.lit('["Python"'), F.lit("[7")))
            .when(form == 5, F.regexp_replace(json, r'"skills":\[[^\]]*\]', '"skills":"Python"'))
            .when(form == 6, F.lit("not JSON at all"))
            .when(form == 7, F.replace(json, F.lit('"summary":'), F.lit('"linkedin":null,"summary":')))
            .otherwise(json)
        )
        people = self.spread_out("customer", ["c_custkey"], ["c_custkey", "c_name", "c_mktsegment"])
        return people.select(F.col("c_custkey").alias("applicant_id"), broken.alias("json"))

    def opening_phrases(self) -> DataFrame:
        """The first words of every document, one to three of them, and twelve of every 50th one."""
        n = F.when(F.col("doc_id") % 50 == 0, 12).otherwise((F.col("doc_id") % 3 + 1).cast("int"))
        first = F.slice(F.split(F.trim("text"), r"\s+"), F.lit(1), n)
        return self.documents().select(F.array_join(first, " ").alias("phrase"))

    def resumes(self) -> DataFrame:
        """Short resumes rendered as text, one per past role: name, one role line, one degree line."""
        c, o = F.col("c_custkey"), F.col("o_orderkey")
        place = F.when(c % 3 == 0, "").otherwise(F.concat(F.col("n_name"), F.lit(" | ")))
        start = (
            F.when(o % 4 == 0, F.date_format("o_orderdate", "yyyy-MM"))
            .when(o % 4 == 1, F.date_format("o_orderdate", "yyyy"))
            .when(o % 4 == 2, F.date_format("o_orderdate", "MMM yyyy"))
            .otherwise(F.date_format("o_orderdate", "MM/yyyy"))
        )
        end = F.when(o % 11 == 0, "Present").when(o % 11 == 1, "").otherwise("2003-05")
        year = (1980 + o % 20).cast("string")
        text = F.concat(
            "c_name", F.lit("\nExperience:\n- "), "o_orderpriority", F.lit(" | "), "o_orderstatus",
            F.lit(" | "), place, start, F.lit(" to "), end,
            F.lit("\nEducation:\n- BSc in "), "c_mktsegment", F.lit(", School of "), "n_name",
            F.lit(", "), year, F.when(o % 9 == 0, ".5").otherwise(""),
        )
        orders = self.spread_out(
            "orders",
            ["o_orderkey"],
            ["o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_orderstatus"],
        )
        customer = self.read("customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
        nation = self.read("nation").select("n_nationkey", "n_name")
        return (
            orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
            .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .select(o.alias("role_id"), c.alias("applicant_id"), text.alias("text"))
        )

    def styled_resumes(self) -> DataFrame:
        """Resumes as people write them: roles in words, in columns, with commas; years in several places."""
        o, c = F.col("o_orderkey"), F.col("c_custkey")
        title, company = F.col("o_orderpriority"), F.concat(F.lit("Works "), "o_orderstatus")
        start = F.date_format("o_orderdate", "yyyy-MM")
        end = F.when(o % 11 == 0, "today").otherwise("2003-05")
        degree = F.concat(F.lit("BSc in "), "c_mktsegment", F.lit(", School of "), "n_name")
        year = 1980 + o % 20
        in_words = F.concat(
            F.lit("* "), title, F.lit(" at "), company, F.lit(" ("), start, F.lit(" – "), end, F.lit(")\n* "), degree,
            F.lit(" ("), year.cast("string"), F.lit(")"),
        )
        in_columns = F.concat(
            F.lit("1. "), title, F.lit(" · "), company, F.lit(" · "), "n_name", F.lit(" · "), start, F.lit(" until "), end,
            F.lit("\n2) "), degree, F.lit(", "), (year - 4).cast("string"), F.lit(" - "), year.cast("string"),
        )
        commas = F.concat(
            F.lit("• "), title, F.lit(", "), company, F.lit(", "), start, F.lit(" - "), end, F.lit("\n• "), degree,
            F.lit(", "), year.cast("string"),
        )
        told = F.when(o % 3 == 0, in_words).when(o % 3 == 1, in_columns).otherwise(commas)
        text = F.concat("c_name", F.lit("\n"), told, F.lit("\n- Led a team of "), (c % 9).cast("string"))
        customer = self.read("customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
        nation = self.read("nation").select("n_nationkey", "n_name")
        orders = self.spread_out(
            "orders", ["o_orderkey"], ["o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_orderstatus"]
        )
        return (
            orders.join(customer, F.col("o_custkey") == c)
            .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .select(o.alias("role_id"), text.alias("text"))
        )
