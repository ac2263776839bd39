"""chronogrid: timetable and staff-record analytics as Spark DataFrame jobs."""
