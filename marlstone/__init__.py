"""Marlstone: analytics over keyed periodic data, as Spark plans."""
