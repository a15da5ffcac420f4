"""Column functions. Everything here stays inside the JVM: no Python UDF is used."""
