"""Column functions: Column in, Column out, all in the JVM unless the module says otherwise."""
