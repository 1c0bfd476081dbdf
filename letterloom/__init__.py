"""Job-application tailoring as whole-table Spark jobs: all postings, all people, all samples."""
